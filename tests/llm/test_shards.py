from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcraft.llm import sharding


def test_write_affected_rows(spark, tmp_path):
    rows = [(i, "x" * 84, 0, f"n{i}") for i in range(10)] + [(None, "y" * 84, 1, "a"), (None, "y" * 84, 1, "b"), (None, "z" * 84, 1, "c")]
    rows += [(99, "u" * 84, 1, "d"), (99, "u" * 84, 1, "e"), (99, "v" * 84, 3, "f"), (99, "u" * 84, 3, "g")]
    rows += [(200 + i, "w" * 84, 2, "h") for i in range(6)]  # a full shard that nothing enters or leaves
    live, key = str(tmp_path / "live"), ("doc_id", "text", "tag")
    made = spark.createDataFrame(rows, "doc_id long, text string, shard int, tag string")
    made.write.partitionBy("shard").parquet(live)
    spark.createDataFrame([(1, "of others")], "doc_id long, text string").write.parquet(f"{live}/shard=7")
    others = {p.name: p.stat().st_mtime_ns for s in (2, 7) for p in (tmp_path / "live" / f"shard={s}").iterdir()}
    docs = spark.read.schema("doc_id long, text string, tag string, shard int").parquet(live).where("shard < 7")
    flow = [(*r[:2], r[2], r[3]) for r in rows]
    want = Counter((r[0], r[1], r[3]) for r in flow)
    plan = sharding.reshard(docs, 3, F.col("shard"), cost=lambda i, j: 0 if i == j else 1).cache()
    assert plan.count() == len(rows)
    # shard 2 keeps all its rows here; the plan of the others is as made
    keep = plan.withColumn("shard", F.when(F.col("old") == 2, 2).otherwise(F.col("shard") % 2)).cache()
    keep.count()
    with pytest.raises(ValueError):
        sharding.write_affected(docs, keep, live)
    touched = sharding.write_affected(docs, keep, live, old_shard=F.col("shard"))
    assert touched == [0, 1, 3]
    back = spark.read.schema("doc_id long, text string, tag string, slot long, shard int").parquet(live).where("shard < 7")
    got = back.collect()
    assert Counter(tuple(r[c] for c in key) for r in got) == want
    assert {r["shard"] for r in got} == {0, 1, 2} and not (tmp_path / "live" / "shard=3").exists()
    assert {p.name: p.stat().st_mtime_ns for s in (2, 7) for p in (tmp_path / "live" / f"shard={s}").iterdir()} == others
