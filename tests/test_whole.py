"""Queries that once left rows out, on rows of their own."""

from __future__ import annotations

import datetime as dt

import pytest
from oracle import DATA, compare, compare_rows, database
from pyspark.sql import functions as F

from panelcraft.operators import asof as A
from panelcraft.plans import catalog

T0 = dt.datetime(2024, 1, 1, 12)


def minutes(n: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=n)


def test_venue_delta_keeps_shared_grid_points(spark, tmp_path):
    """Two views near one hour: the earliest that has a rate is matched, as the SQL twin has it."""
    rows = [(1, minutes(-5), 7, "view", 2.0), (2, minutes(3), 7, "view", 9.0), (3, minutes(1), 7, "click", 0.5),
            (4, minutes(-9), 8, "view", None), (5, minutes(2), 8, "view", 4.0), (6, minutes(0), 8, "click", 1.0), (7, minutes(60), 8, "click", 1.0),
            (8, minutes(4), None, "view", 1.0), (9, minutes(4), None, "click", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("props", F.lit("{}"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = database(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalog.QUERIES["jn03_venue_delta"](spark, str(tmp_path))
    assert sorted((r["key"], r["rate_left"], r["rate_right"], r["rate_delta"]) for r in found.collect()) == [(7, 2.0, 0.5, 1.5), (8, 4.0, 1.0, 3.0)]
    assert compare_rows(found, con, catalog.ORACLE["jn03_venue_delta"]) == ""


def test_strict_match_takes_clean_events(spark):
    rates = spark.createDataFrame([("a", minutes(-5), 1.0), ("a", minutes(3), 2.0), ("a", minutes(61), 3.0)], "key string, ts timestamp_ntz, rate double")
    with pytest.raises(Exception, match="clean interval grid"):
        A.venue_delta(rates, rates, ["key"], 1).collect()
    clean = A.clean_events(rates, ["key"], 1)
    assert [r["rate_left"] for r in A.venue_delta(clean, clean, ["key"], 1).collect()] == [3.0]


def test_random_entries_of_short_keys(spark):
    """A key with fewer than 25 entries gives all of them."""
    sf = f"{DATA}/sf0.001"
    short = {(r["symbol"], r["horizon"]): r["n_entries"] for r in catalog.QUERIES["top04_short_schedules"](spark, sf).collect()}
    given = catalog.QUERIES["top04_random_entries"](spark, sf).groupBy("symbol", "horizon").count().collect()
    counts = {(r["symbol"], r["horizon"]): r["count"] for r in given}
    assert short and all(counts[k] == n for k, n in short.items()) and all(n == 25 for k, n in counts.items() if k not in short)
    assert compare(spark, database(sf), "top04_random_entries", sf).startswith("ok")
