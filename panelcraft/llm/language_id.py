"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .scratch import Scratch
from .words import mix, small

#: Number of hash buckets of n-grams.
BUCKETS = 1 << 15
#: Lengths of n-grams.
LENGTHS = (1, 2, 3)
#: Added to every count.
SMOOTHING = 0.5
#: Most languages of one block of the model, so that the broadcast matrix stays below 64 MB; more are scored in turn.
MOST_LANGUAGES = 512
#: Characters handled at once; longer texts go in pieces that overlap.
PIECE = 1 << 18
SPACE = 32

_LETTERS: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: its lower-case form if that is one letter, else a space."""
    global _LETTERS
    if _LETTERS is None:
        out = np.full(sys.maxunicode + 1, SPACE, np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS = out
    return _LETTERS


def pieces(text: str) -> Iterator[np.ndarray]:
    """Letters of the text with each run of other characters as one space, in overlapping pieces."""
    letters = letter_table()
    tail = np.array([SPACE], np.uint32)
    for i in range(0, len(text), PIECE):
        codes = letters[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([tail, codes])
        keep = (codes != SPACE) | np.concatenate([[True], codes[:-1] != SPACE])
        codes = codes[keep]
        yield codes
        tail = codes[-(max(LENGTHS) - 1) :]


def ngram_buckets(codes: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of each length; those inside the first ``overlap`` codes were counted before."""
    wide = codes.astype(np.uint64)
    for n in LENGTHS:
        start = max(0, overlap - n + 1)
        m = len(wide) - n + 1
        if m <= start:
            continue
        key = np.full(m - start, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x110000) + wide[start + k : m + k]
        yield (mix(key) >> np.uint64(49)).astype(np.int64)


def document_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text; nothing if it has no letter."""
    overlap = 0
    for codes in pieces(text or ""):
        if len(codes) > overlap and (codes != SPACE).any():
            yield from ngram_buckets(codes, overlap)
        overlap = min(len(codes), max(LENGTHS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of a task's texts, one matrix row per language it has met; a full matrix goes out as it is."""
    totals: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "bucket", "n"])
        totals.clear()

    for batch in small(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in totals and len(totals) >= MOST_LANGUAGES:
                yield from out()
            own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for found in document_buckets(text):
                own += np.bincount(found, minlength=BUCKETS)
    yield from out()


@dataclass
class LanguageModel:
    """``log_prob[bucket, language]``, with the languages in sorted order."""

    languages: list[str]
    log_prob: np.ndarray

    def totals(self, text: str | None) -> np.ndarray | None:
        """Log-likelihood of each language; None if the text has no letter."""
        total, seen = np.zeros(len(self.languages)), False
        for found in document_buckets(text):
            seen = True
            total += self.log_prob[found].sum(axis=0, dtype=np.float64)
        return total if seen else None

    def scores(self, text: str | None) -> np.ndarray | None:
        """Posterior of each language under equal priors; None if the text has no letter."""
        total = self.totals(text)
        if total is None:
            return None
        p = np.exp(total - total.max())
        return p / p.sum()


@dataclass
class Blocks:
    """A model of more than ``MOST_LANGUAGES`` languages: counts in a table, made into one block at a time."""

    languages: list[str]
    sums: DataFrame

    def __iter__(self) -> Iterator[LanguageModel]:
        for i in range(0, len(self.languages), MOST_LANGUAGES):
            names = self.languages[i : i + MOST_LANGUAGES]
            yield _matrix(names, self.sums.where(F.col("lang").between(names[0], names[-1])).toArrow())


def _matrix(languages: list[str], sums: pa.Table) -> LanguageModel:
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = pc.index_in(sums["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
    counts[sums["bucket"].to_numpy(), column] += sums["n"].to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | Blocks:
    """Count n-grams per language over all given rows whose language is not null.

    Each task adds up its own texts; only (language, bucket) sums are shuffled. Their number is bounded by
    languages times ``BUCKETS``; the driver holds those of ``MOST_LANGUAGES`` at a time. Texts that are null or
    have no letter add nothing.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = Scratch(docs.sparkSession, "languages").save(sums, "sums")
    # the order of code points is that of UTF-8 bytes, by which Spark compares
    languages = sorted(sums.select("lang").distinct().toArrow()["lang"].to_pylist())
    return _matrix(languages, sums.toArrow()) if len(languages) <= MOST_LANGUAGES else Blocks(languages, sums)


def _add_block(batches: Iterator[pa.RecordBatch], shipped, field: str) -> Iterator[pa.RecordBatch]:
    """The likeliest language so far, its log-likelihood, and the sum of all likelihoods as multiples of it."""
    model: LanguageModel = shipped.value
    for batch in small(batches):
        names, best, sums = (batch.column(i).to_pylist() for i in range(3))
        for i, text in enumerate(batch.column(3).field(field).to_pylist()):
            total = model.totals(text) if model.languages else None
            if total is None:
                continue
            top = float(total.max())
            high = max(top, best[i])
            sums[i] = sums[i] * np.exp(best[i] - high) + float(np.exp(total - high).sum())
            if top > best[i]:
                names[i] = model.languages[int(total.argmax())]
            best[i] = high
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(sums, pa.float64()), batch.column(3)],
                                         names=["lang", "best", "sum", "row"])


def _tell(rows: DataFrame, model: LanguageModel | Blocks, field: str) -> DataFrame:
    """``lang, score, row`` for rows of one struct ``row`` whose text is ``field``.

    One block is one pass. Further blocks take a pass each, over rows written in between, so no task holds more
    than one block.
    """
    spark, kind = rows.sparkSession, rows.schema["row"].dataType
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("best", T.DoubleType()), T.StructField("sum", T.DoubleType()),
                           T.StructField("row", kind)])
    told = rows.select(F.lit("und").alias("lang"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("sum"), "row")
    scratch, before = Scratch(spark, "told"), None
    for block in [model] if isinstance(model, LanguageModel) else model:
        shipped = spark.sparkContext.broadcast(block)
        told = told.mapInArrow(partial(_add_block, shipped=shipped, field=field), schema)
        if isinstance(model, Blocks):
            told = scratch.save(told, "block")
            shipped.destroy()
            if before is not None:
                scratch.drop(before)
            before = told
    score = F.when(F.col("sum") > 0, 1 / F.col("sum")).otherwise(0.0)
    return told.select("lang", score.alias("score"), "row")


def identify(docs: DataFrame, model: LanguageModel | Blocks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the likeliest language and its posterior.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language. Ties go to the
    language first in sorted order. Rows that repeat an id are predicted one by one; other columns are not read.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).alias("row"))
    return _tell(rows, model, "text").select("row.doc_id", F.col("lang").alias("lang_pred"), "score")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _has_letter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in small(batches):
        keep = [any((letters[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)] != SPACE).any()
                    for i in range(0, len(text), PIECE)) for text in (t or "" for t in batch.column(0).field("text").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a letter go on, with ``lang`` as predicted where it was null.

    Only texts without a letter are rejected: nothing in them can be read in any language. Whether a text has one
    does not depend on the model; if that knows no language, the prediction is ``und``. Further columns stay,
    whatever their names.
    """
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    rows = docs.select(F.struct("*").alias("row"))
    told = _tell(rows, model, "text")
    if model.languages:  # then exactly the texts without a letter are told no language
        told = told.where("score > 0")
    else:
        told = rows.mapInArrow(_has_letter, rows.schema).select(F.lit("und").alias("lang"), "row")
    return told.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang")).alias("row")).select("row.*")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
