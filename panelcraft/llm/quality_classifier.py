"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .registry import query, table
from .scratch import Scratch
from .words import lists, mix, small

#: Hash buckets of features; bucket 0 is the bias.
BUCKETS = 1 << 18
#: Labelled rows used for training: those with the smallest hashes of their ids.
MOST_ROWS = 8192
#: Passes over the training rows.
EPOCHS = 2
#: Step size, its offset, and the strengths of the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.01
#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3
CACHE_TOKENS = 400_000
#: A token is a run of letters and digits, or a run of other signs; lower and upper case differ.
TOKEN = re.compile(r"\w+|[^\w\s]+")


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, hashes: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: token uni- and bigrams, roots of their shares, and the bias.

    A token next to itself is one feature whatever the token, and so is a token that stands two places on again.
    """
    tokens = TOKEN.findall(text) if text else []
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    if not len(one):
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    two[one[:-1] == one[1:]] = 1
    skip = np.full(int((one[:-2] == one[2:]).sum()), 2, np.uint64)
    bucket = (mix(np.concatenate([one, two, skip])) >> np.uint64(46)).astype(np.int32)
    at, count = np.unique(np.maximum(bucket, 1), return_counts=True)
    value = np.sqrt(count / count.sum())
    return np.append(np.int32(0), at).astype(np.int32), np.append(1.0, value).astype(np.float32)


@dataclass
class Leader:
    """State of the follow-the-regularised-leader optimiser."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = MOST_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from the labelled rows given; ``labels`` must already be restricted to those that may teach.

    At most ``most_rows`` labelled rows are used, so one task can take the updates in order; each pass is one job
    over the written features, and only the optimiser's state (two numbers per bucket) is handed on. Null labels
    and labels without a document teach nothing; without any label all scores are 0.5. The broadcast ids are
    bounded by ``most_rows``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    chosen = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("doc_id"))
    chosen = chosen.orderBy("turn", "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("turn", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in small(batches):
            found = [features(text, hashes) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists([f[0] for f in found], pa.int32()), lists([f[1] for f in found], pa.float32())],
                names=["turn", "label", "at", "x"])

    rows = scratch.save(rows.mapInArrow(extract, "turn long, label int, at array<int>, x array<float>"), "features")
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(epochs):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            leader = Leader(state.value[0].copy(), state.value[1].copy())
            for batch in small(batches):
                for label, at, x in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    leader.learn(at.values.to_numpy(), x.values.to_numpy().astype(np.float64), label)
            yield pa.RecordBatch.from_arrays([pa.array([leader.z.tobytes()]), pa.array([leader.n.tobytes()])], names=["z", "n"])

        after = rows.repartition(1).sortWithinPartitions("turn").mapInArrow(run, "z binary, n binary").first()
        if after is not None:
            z, n = (np.frombuffer(bytes(after[k]), np.float64).copy() for k in ("z", "n"))
    return Leader(z, n).weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: a sparse dot product per text, through the logistic function.

    A null or empty text has the bias only. Rows that repeat an id are scored one by one; other columns are not
    read. The weights are one number per bucket.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = TokenHashes(), shipped.value
        for batch in small(batches):
            margin = []
            for text in batch.column(1).to_pylist():
                at, x = features(text, hashes)
                margin.append(float(w[at] @ x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(margin, float), -35, 35))))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
