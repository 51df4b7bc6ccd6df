"""Content fingerprints that do not depend on file layout or row order: a tree of digests with bounded nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that a leaf holds on average, and most levels of a key's tree.
LEAF_ROWS, MOST_LEVELS = 100_000, 8


def line(columns: Sequence[str], sep: str = "|") -> Column:
    """One text line per row; NULL is the empty field."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _joined(parts: Column) -> Column:
    """Digest of sorted texts."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)


def levels_for(df: DataFrame, key: str, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels at which the leaves of the largest key hold about `leaf_rows` distinct rows; a function of the content only."""
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return next((d for d in range(MOST_LEVELS) if leaf_rows * 16**d >= most), MOST_LEVELS)


def leaves(df: DataFrame, key: str, columns: Sequence[str], levels: int) -> DataFrame:
    """Leaves (key, prefix, digest, n_rows): a row belongs to the leaf that the first `levels` hex digits of its digest name.

    Equal rows are counted before they meet, so copies of one row take no room. The range of digests is cut evenly,
    so a leaf holds a 16th of its parent's distinct rows, whatever they are.
    """
    rows = df.groupBy(F.col(key).alias("key"), F.sha2(line(columns), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("key", F.substring("d", 1, levels).alias("prefix")).agg(
        _joined(F.concat_ws("*", "d", "n")).alias("digest"), F.sum("n").alias("n_rows"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: children in the order of their prefixes, sixteen at most."""
    up = F.expr("substring(prefix, 1, greatest(length(prefix) - 1, 0))")
    return nodes.groupBy("key", up.alias("prefix")).agg(_joined(F.concat_ws(":", "prefix", "digest")).alias("digest"), F.sum("n_rows").alias("n_rows"))


def key_digests(df: DataFrame, key: str, columns: Sequence[str], levels: int | None = None) -> DataFrame:
    """The root (key, digest, n_rows) of every key's tree."""
    levels = levels_for(df, key) if levels is None else levels
    nodes = leaves(df, key, columns, levels)
    for _ in range(levels):
        nodes = parents(nodes)
    return nodes.drop("prefix")


def content_fingerprint(df: DataFrame, key: str, columns: Sequence[str], levels: int | None = None, key_levels: int = 2) -> DataFrame:
    """Digest of the whole table: the keys' roots form a tree over the digests of the keys' names.

    No task holds more than a leaf of rows or the keys of one name prefix.
    """
    roots = key_digests(df, key, columns, levels)
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    nodes = roots.groupBy(F.lit("").alias("key"), F.substring(F.sha2(name, 256), 1, key_levels).alias("prefix")).agg(
        _joined(F.concat_ws("=", name, "digest")).alias("digest"), F.sum("n_rows").alias("n_rows"))
    for _ in range(key_levels):
        nodes = parents(nodes)
    return nodes.select(F.col("digest").alias("fingerprint"), "n_rows")


def differing_leaves(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], levels: int) -> DataFrame:
    """The leaves in which two tables differ, with both row counts (NULL where one table has no such leaf)."""
    left, right = (leaves(df, key, columns, levels).select("key", "prefix", F.col("digest").alias(f"d{i}"), F.col("n_rows").alias(f"n_rows_{i}"))
                   for i, df in ((1, a), (2, b)))
    same = left["key"].eqNullSafe(right["key"]) & (left["prefix"] == right["prefix"])
    both = left.join(right, same, "full").filter(~F.col("d1").eqNullSafe(F.col("d2")))
    return both.select(F.coalesce(left["key"], right["key"]).alias("key"), F.coalesce(left["prefix"], right["prefix"]).alias("prefix"), "n_rows_1", "n_rows_2")
