"""From raw documents to a deduplicated, balanced and tokenised corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcraft.llm.bpe import tokenise
from panelcraft.llm.exact_dedup import drop_copies
from panelcraft.llm.language_id import drop_unknown_language
from panelcraft.llm.mixing import sample_to_targets
from panelcraft.llm.near_dedup import drop_near_copies
from panelcraft.llm.scratch import Scratch

#: Each stage takes (spark, docs, sf_dir); its rows are written and read again as the next one's docs.
STAGES = [
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", sample_to_targets),
    ("bpe", tokenise),
]

#: Near duplicates, raking and exact BPE have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
