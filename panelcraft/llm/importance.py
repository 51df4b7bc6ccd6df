"""Target-distribution importance resampling: array-scored weights, noisy scores, an exact cutoff by weighted medians."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plain_words import word_pieces
from .registry import query, table
from .scratch import Scratch
from .selection import kth_key, precedes, same
from .words import binary, small

#: Buckets that features are hashed to.
BUCKETS = 10_000
#: Words up to this many bytes have their checksum cached and joined by table; longer ones are summed byte by byte.
SHORT = 62
#: Words that a task remembers before it starts anew.
CACHE_WORDS = 400_000
#: Production parameters: share of the documents drawn, fewest words, seed of the noise.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
LOW = 0xFFFFFFFF


def zero_shifts(longest: int) -> np.ndarray:
    """Per number of zero bytes and byte of a CRC-32, what that byte becomes after them: (number, byte place, byte)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = (out[n] >> 8) ^ step[out[n] & 0xFF]
    return out


class Codes(dict):
    """Length and checksum of a word as one number, ``length << 32 | crc32``; remembers short words."""

    def __missing__(self, word: bytes) -> int:
        value = len(word) << 32 | zlib.crc32(word)
        if len(word) <= SHORT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


class Features:
    """Buckets of the runs of one and two words of a text.

    The checksum of two joined strings is that of the first, moved by the length of the second, xor that of the
    second. So pairs are never built: their checksums come from those of the words, for a whole array at once.
    """

    def __init__(self) -> None:
        self.codes, self.shifts = Codes(), zero_shifts(SHORT + 1)
        space = zlib.crc32(b" ")
        self.space = np.bitwise_xor.reduce([self.shifts[:, k, space >> 8 * k & 0xFF] for k in range(4)])
        self.flat = self.shifts.ravel()

    def pairs(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        """crc32 of each word, a space and the next word."""
        first, second, length = codes[:-1] & LOW, codes[1:] & LOW, codes[1:] >> 32
        near = np.minimum(length, SHORT)
        base = (near + 1) << 10
        out = self.space[near] ^ second.astype(np.uint32)
        for k in range(4):
            out ^= self.flat[base + (k << 8) + (first >> 8 * k & 0xFF)]
        for i in np.flatnonzero(length > SHORT):
            out[i] = zlib.crc32(b" " + words[i + 1], int(first[i]))
        return out

    def of(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """Pieces of a text: number of new words, and the buckets of the features that end in them."""
        last: list[bytes] = []
        for words in word_pieces(text):
            if not words:
                continue
            both = last + words
            codes = np.fromiter(map(self.codes.__getitem__, both), np.int64, len(both))
            buckets = np.concatenate([codes[len(last) :] & LOW, self.pairs(both, codes)])
            yield len(words), buckets % BUCKETS
            last = words[-1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros(BUCKETS, np.int64)
    for batch in small(batches):
        for text in binary(batch.column(0)):
            for _, buckets in features.of(text):
                counts += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts per bucket. Each task sends one row per bucket; the driver gets one number per bucket."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and raw shares, per bucket."""
    all_raw, all_target = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_raw / ((float(s) + 1) * all_target)))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that depends on seed and id only, so a repeated task draws the same."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(batches: Iterator[pa.RecordBatch], gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in small(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
            words = n = total = 0
            for new, buckets in features.of(text):
                words, n, total = words + new, n + len(buckets), total + int(gains[buckets].sum())
            weight = total // n if n else 0
            rows.append((words, n, weight, weight + noise(doc_id, seed)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                         names=["doc_id", "n_words", "n_features", "weight", "score"])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` words or more so that their features follow ``target``.

    Features are runs of one and two words, counted by hashed bucket over all of ``docs`` and ``target``. A document's
    weight is the floored mean of its features' gains; its score adds Gumbel noise made of its id, so the highest
    scores are a draw without replacement by weight. The score of the last one drawn is found by weighted
    median-of-medians over passes of small rows; the winners alone are sorted, by range, for their rank.

    Returns ``doc_id, n_features, weight, score, rank, n_words``, one row per input row; undrawn rows have no rank.
    Null texts and texts without a word have weight 0 and are never drawn; texts of any length are read in pieces.
    Ties go to the smaller id; null ids share the noise of the empty string and come last; rows that repeat id and
    score tie in an order that is fixed once the winners are written. An empty table gives no row, an empty target
    gains from an even spread. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = scratch.save(texts.mapInArrow(
        partial(_score, gains=gains, seed=seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    fields = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]

    order = ["before_score", "no_id", "id"]
    keyed = scored.select("*", (-F.col("score")).alias("before_score"), F.col("doc_id").isNull().cast("long").alias("no_id"),
                          F.coalesce("doc_id", F.lit(0)).alias("id"))
    fit = F.col("n_words") >= least_words
    wanted = percent * scored.where(fit).count() // 100
    if not wanted:
        return scored.select(*fields, F.lit(None).cast("long").alias("rank"), "n_words")
    cutoff = kth_key(scratch.save(keyed.where(fit).select(*order), "keys"), wanted, scratch)
    won = fit & (precedes(order, cutoff) | same(order, cutoff))

    # position inside each range of the sorted winners, then the sizes of the ranges before it
    winners = keyed.where(won).orderBy(*order, "weight", "n_features").select("*", F.monotonically_increasing_id().alias("at"))
    winners = scratch.save(winners.select("*", F.shiftright("at", 33).cast("int").alias("range")), "winners")
    sizes, offsets, past = winners.groupBy("range").count().orderBy("range").collect(), [], 0
    for r in sizes:
        offsets.append((r["range"], past - (r["range"] << 33)))
        past += r["count"]
    ranges = spark.createDataFrame(offsets, "range int, offset long")  # as many rows as the sort has tasks
    rank = F.col("at") + F.col("offset") + 1
    drawn = winners.join(F.broadcast(ranges), "range").select(*fields, F.when(rank <= wanted, rank).alias("rank"), "n_words")
    return keyed.where(~won).select(*fields, F.lit(None).cast("long").alias("rank"), "n_words").union(drawn)


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
