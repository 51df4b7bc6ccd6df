"""Archives, sections, drifting headers, sized writes, file audits and fingerprints."""

from __future__ import annotations

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from panelcraft.operators import fingerprint as FP
from panelcraft.sources import archives, landed as L, sizing


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 64)
    rng = random.Random(3)
    rows = [(f"a{i % 3}.zip", f"m{i % 5}.csv", f"{i},é{rng.random()}") for i in range(500)]
    df = spark.createDataFrame(rows, "archive string, member string, value string")
    archives.write_zipped_lines(df.repartition("archive").sortWithinPartitions("archive", "member"), str(tmp_path / "z"))
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["a0.zip", "a1.zip", "a2.zip"]
    back = archives.read_zipped_lines(spark, f"file://{tmp_path}/z")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.rdd.getNumPartitions() == 15  # a task per member
    with zipfile.ZipFile(tmp_path / "z" / "other.zip", "w") as archive:
        archive.writestr("folder/x.csv", "1\r\n2")
        archive.writestr("empty.csv", "")
    assert [r["value"] for r in archives.read_zipped_lines(spark, f"{tmp_path}/z", "other*").collect()] == ["1", "2"]
    with pytest.raises(Exception):  # one archive out of two tasks
        archives.write_zipped_lines(df.filter("archive = 'a0.zip'").repartition(2, "member"), str(tmp_path / "bad"))
    assert [p for p in (tmp_path / "bad").iterdir()] == []


def test_funding_archive_with_a_changed_header_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "C-fundingRate-2020-01.zip", "w") as archive:
        archive.writestr("C-fundingRate-2020-01.csv", "calc_time,hours,last_funding_rate\n1700000000000,8,0.0001\n")
    with pytest.raises(Exception):
        L.read_funding_archives(spark, str(tmp_path)).collect()


def test_sections_over_parts_of_a_file(spark, tmp_path):
    body = ["pre"] + [x for s in range(5) for x in [f"title {s}"] + [f"{s}-{i}" for i in range(200)]]
    (tmp_path / "one.txt").write_text("\n".join(body))
    (tmp_path / "two.txt").write_text("title\nx")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # a part every fifty lines
    try:
        rows = L.read_sections(spark, str(tmp_path), "^title").collect()
        assert L.placed_lines(spark, str(tmp_path)).select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["path"].rsplit("/", 1)[1], r["value"]): r["section"] for r in rows}
    want, section = {("two.txt", "title"): 1, ("two.txt", "x"): 1}, 0
    for line in body:
        section += line.startswith("title")
        want["one.txt", line] = section
    assert got == want


@pytest.mark.parametrize("text, message", [("Date,10 Yr\n01/02/2019,1.0", "outside"), ("Date,10 Yr\n01/02/2020,0", "above zero"), ("Date,9 Yr\n01/02/2020,1", "column"),
                                           ("Date,10 Yr\n01/02/2020,1\n01/02/2020,2", "repeated")])
def test_rate_years(spark, tmp_path, text, message):
    (tmp_path / "2020.csv").write_text('"1 Mo","10 Yr",Date\n1,2.5,01/03/2020\n1,,01/04/2020\n\n')
    (tmp_path / "2021.csv").write_text("Date,10 Yr\n05/03/2021, 3.5\n")
    good = {str(r["date"]): r["rate"] for r in L.read_rate_years(spark, str(tmp_path)).collect()}
    assert good == {"2020-01-03": 0.025, "2021-05-03": 0.035}
    (tmp_path / "bad2020.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        L.read_rate_years(spark, str(tmp_path / "bad2020.csv")).collect()


@pytest.mark.parametrize("copies", [False, True])
def test_sized_writes(spark, tmp_path, copies):
    rows = [("hot" if i % 2 else f"k{i % 40}", 7 if copies and i % 2 else i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(40)
    tasks = sizing.sized(df, "k", 300, ["v"]).select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys")).collect()
    assert max(r["n"] for r in tasks) <= (700 if copies else 420) and len(tasks) >= 14 and sum(r["n"] for r in tasks) == 4000
    sizing.sized(df, "k", 300).write.partitionBy("k").parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect())) == sorted(rows)
    assert 7 <= len(list((tmp_path / "t" / "k=hot").glob("*.parquet"))) <= 8 and len(list((tmp_path / "t" / "k=k2").glob("*.parquet"))) == 1
    assert sizing.sized(df.limit(0), "k").count() == 0


def test_audit(spark, tmp_path):
    made = {n: bytes(random.Random(n).randrange(256) for _ in range(size)) for n, size in (("a", 5), ("b", 3_000_000), ("c", 0), ("d", 9), ("e", 4), ("g", 2))}
    for n, data in made.items():
        (tmp_path / n).write_bytes(data)
    digest = {n: hashlib.sha256(data).hexdigest() for n, data in made.items()}
    landed = L.file_digests(spark, str(tmp_path))
    assert {r["file_name"]: (r["sha256"], r["size_bytes"]) for r in landed.collect()} == {n: (digest[n], len(made[n])) for n in made}
    manifest = [("a", digest["a"].upper(), 5), ("b", digest["b"], 1), ("c", digest["a"], 0), ("e", digest["e"], 4), ("f", "00", 1), ("g", digest["g"], 2)]
    lines = spark.createDataFrame([(f"{digest['a']}  a",), (f"{digest['b']} *b",), (f"{'0' * 64}  e",), ("",)], "value string")
    out = L.audit_files(landed, spark.createDataFrame(manifest, "file_name string, sha256 string, size_bytes long"), L.checksum_lines(lines))
    assert {r["file_name"]: r["status"] for r in out.collect()} == {
        "a": "ok", "b": "size_differs", "c": "hash_differs", "d": "unlisted", "e": "vendor_differs", "f": "missing", "g": "vendor_unlisted"}
    with pytest.raises(Exception):
        L.checksum_lines(spark.createDataFrame([("abc  x",)], "value string")).collect()


def test_fingerprint(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 9 + ["x", "y", None]), rng.randrange(10_000), rng.random()) for _ in range(3000)] + [("hot", 1, 0.5)] * 500
    df = spark.createDataFrame(rows, "k string, a long, b double")
    root = FP.content_fingerprint(df, "k", ["k", "a", "b"], 3).first()
    assert root == FP.content_fingerprint(df.orderBy("b").repartition(7), "k", ["k", "a", "b"], 3).first() and root["n_rows"] == 3500
    k, a, b = rows[17]
    other = spark.createDataFrame(rows[:17] + [(k, a + 1, b)] + rows[18:], df.schema)
    assert FP.content_fingerprint(other, "k", ["k", "a", "b"], 3).first()["fingerprint"] != root["fingerprint"]
    assert FP.content_fingerprint(spark.createDataFrame(rows[:-1], df.schema), "k", ["k", "a", "b"], 3).first()["fingerprint"] != root["fingerprint"]  # one copy fewer
    differ = FP.differing_leaves(df, other, "k", ["k", "a", "b"], 2).collect()
    assert 1 <= len(differ) <= 2 and {r["key"] for r in differ} == {k}
    found = FP.leaves(df, "k", ["k", "a", "b"], 2)
    assert found.filter("key = 'hot'").count() == 256 and FP.levels_for(df, "k", 100) == 2 and FP.levels_for(df.limit(0), "k") == 0
