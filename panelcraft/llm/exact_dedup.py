"""Exact duplicates: one row per document with the id of the row that stays."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import columns, query, table
from .scratch import Scratch

SPACE_RUN = r"[\x20\x09-\x0D]+"


def squeeze_space(text: Column) -> Column:
    """Replace each run of ASCII white space by one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def md5_bytes(text: Column) -> Column:
    """128-bit content hash."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] = squeeze_space, content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """Group documents by a 128-bit hash of their normalised text and keep the smallest id of each group.

    Inside a hash group the bytes decide: the grouping key is (hash, text), so texts that share a hash by
    accident form groups of their own. The aggregation combines copies before the shuffle; a group with a third
    of all rows becomes one row per map task. Ids are then joined to the groups by hash alone, without text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. A null text counts as
    empty, and all empty texts are one group. Null ids sort last; where a group has null ids only, all its rows
    are kept. Rows that repeat an id with the same text get the same result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("hash", content_hash(F.col("text")))
    groups = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    scratch = Scratch(docs.sparkSession, "exact")
    groups = scratch.save(groups.select("hash", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")), "groups")

    shared = groups.groupBy("hash").count().where("count > 1").select("hash")
    joined = rows.select("doc_id", "hash").join(groups, "hash")
    if not shared.isEmpty():  # texts that share a hash: find each row's group by its text
        shared = scratch.save(shared, "shared")
        own = rows.join(F.broadcast(shared) if shared.count() < 10_000 else shared, "hash", "left_semi")
        exact = own.groupBy("hash", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = own.join(exact, ["hash", "text"]).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
        joined = joined.join(shared, "hash", "left_anti").unionByName(apart)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row per group of equal normalised texts, columns unchanged.

    The row itself goes through the grouping, so rows that share an id or have none are told apart: of each group
    the row with the smallest id stays, null ids last. Where a group has that id on several rows, a hash of their
    columns decides. Map-side combine leaves one row per task of a group, however large it is.
    """
    norm = squeeze_space(F.coalesce(F.col("text"), F.lit("")))
    plain = [c for c, f in zip(columns(docs), docs.schema, strict=True) if not re.search("map<|variant", f.dataType.simpleString())]
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*plain))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), norm.alias("norm"), md5_bytes(norm).alias("hash"), order.alias("order"))
    return rows.groupBy("hash", "norm").agg(F.min_by("row", "order").alias("row")).select("row.*")


@query("op1_exact_dedup", sql=r"""
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY norm)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
