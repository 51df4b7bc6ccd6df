"""Quality rules: base counts, and repetition inside a text found with a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import WordHashes, binary, lists, small

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Shortest repeat that counts, in words.
LEAST_WORDS = 8
#: Most words of a text, in percent, that repeats may cover, and the longest repeat allowed, in words. Of the labelled
#: texts that repeat 20 words or more, none is of good quality; of those that repeat 8 to 19 and pass the base test, nine in ten are.
MOST_COVERED_PERCENT, LONGEST_REPEAT = 30, 30
#: Fewest words of a text.
FEWEST_WORDS = 20


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4, ... words."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    ranks, width = [rank], 1
    while True:
        if rank.max() == n - 1 or width >= n:
            break
        key = (rank.astype(np.int64) + 1) * (n + 1)
        key[: n - width] += rank[width:] + 1
        key[n - width :] += 0
        _, rank = np.unique(key, return_inverse=True)
        ranks.append(rank)
        width *= 2
    return np.argsort(rank, kind="stable"), ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the next one in order, by descending doubling ranks."""
    n = len(order)
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << level, ranks[level]
        ok = np.flatnonzero((i + width <= n) & (j + width <= n))
        ok = ok[rank[i[ok]] == rank[j[ok]]]
        lcp[ok] += width
        i[ok] += width
        j[ok] += width
    return lcp


def repeats(words: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, int]:
    """Union of the spans of all repeated runs of ``least`` words or more, as (begin, end) rows; longest run.

    A maximal interval of the prefix array with values of ``least`` or more is one family of repeats. In it each
    suffix's longest repeat reaches as far as its larger neighbouring prefix; these maximal runs cover all others.
    """
    n = len(words)
    if n <= least:
        return np.empty((0, 2), np.int64), 0
    order, ranks = suffix_array(words)
    lcp = common_prefixes(order, ranks)
    if not len(lcp) or lcp.max() < least:
        return np.empty((0, 2), np.int64), 0
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    begin = np.flatnonzero(reach >= least)
    end = np.maximum.accumulate(begin + reach[begin])
    new = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return np.stack([begin[np.append(0, new)], end[np.append(new - 1, len(end) - 1)]], axis=1), int(lcp.max())


def _judge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in small(batches):
        rows, spans = [], []
        for text in binary(batch.column(1)):
            text = text or b""
            parts = text.split()
            found, longest = repeats(hashes.of(parts), least)
            points = np.frombuffer(text, np.uint8)
            code_points = int(np.count_nonzero((points & 0xC0) != 0x80))
            white = len(text) - len(text.translate(None, WHITE))
            lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
            rows.append((len(parts), code_points - white, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                         int((found[:, 1] - found[:, 0]).sum()), longest))
            spans.append(found.ravel())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), lists(spans, pa.int64())],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "spans"])


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Counts of every text and the spans of its repeats; ``spans`` holds begin, end, begin, end, ... in words.

    ``n_repeat_words`` is the number of words the repeats cover. A null or empty text has zeros and no span; an empty
    table gives no rows. A text is judged as a whole, however long: memory grows with its words
    and the logarithm of its longest repeat.
    Rows that repeat an id are judged one by one; other columns are not read. Equality of words is that of their
    64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_judge, least=least), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "longest_repeat long, spans array<long>")


def judged(found: DataFrame) -> DataFrame:
    """``repetition``'s rows with ``base_failed`` and ``kept``: the base test, then the limits on coverage and longest repeat."""
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = (100 * F.col("n_repeat_words") <= MOST_COVERED_PERCENT * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST_REPEAT)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & limits)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents"))
    return judged(found)
