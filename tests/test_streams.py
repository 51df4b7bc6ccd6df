"""Tables kept up by streams: any order of arrival, repeated batches, state that goes on and ends."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcraft.operators.panel import settled_events
from panelcraft.streaming import jobs as J

EVENTS = "symbol string, ts timestamp_ntz, rate double, realized boolean, ingest long"


def events(n: int = 400) -> list:
    rng = random.Random(4)
    return [(rng.choice("abcdef"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(40)), rng.randrange(5) / 1000, rng.random() < 0.7, i) for i in range(n)]


def rows_of(df) -> list:
    return sorted(map(tuple, df.select("symbol", "ts", "rate", "realized").collect()))


def test_upsert_any_order(spark, tmp_path):
    rows = events()
    random.Random(1).shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = J.settled_table(str(tmp_path / "table"), buckets=3)
    assert kept.read(spark) is None
    kept.follow(J.settled_parts(stream), str(tmp_path / "log"))
    found = J.settled_rows(kept.read(spark))
    assert kept.committed(spark) == 4
    assert rows_of(found) == rows_of(settled_events(spark.createDataFrame(rows, EVENTS)))
    assert found.agg(F.sum("n_rows")).first()[0] == len(rows)
    rates = {}
    for s, ts, rate, realized, _ in rows:
        rates.setdefault((s, ts), set()).update({rate} if realized else set())
    assert {(r["symbol"], r["ts"]) for r in found.where("conflict").collect()} == {k for k, v in rates.items() if len(v) > 1}


def test_upsert_repeats_and_failures(spark, tmp_path):
    rows = events()
    kept = J.settled_table(str(tmp_path / "table"), buckets=4)
    parts = [J.settled_parts(spark.createDataFrame(rows[a:b], EVENTS)) for a, b in ((0, 150), (150, 151), (151, 400))]
    kept.apply(parts[0], 0)
    kept.apply(parts[0], 0)  # committed before: changes nothing
    assert J.settled_rows(kept.read(spark)).agg(F.sum("n_rows")).first()[0] == 150
    # a run of batch 1 that wrote other rows and died before it was committed
    kept._merged(parts[2].select("*", F.lit(1).alias("bucket"))).withColumn("version", F.lit(1)).write.mode("append").partitionBy("bucket", "version").parquet(f"{kept.path}/rows")
    assert J.settled_rows(kept.read(spark)).agg(F.sum("n_rows")).first()[0] == 150
    for k in (1, 2):
        kept.apply(parts[k], k)
    assert rows_of(J.settled_rows(kept.read(spark))) == rows_of(settled_events(spark.createDataFrame(rows, EVENTS)))
    assert J.settled_rows(kept.read(spark)).agg(F.sum("n_rows")).first()[0] == 400
    kept.apply(parts[0].limit(0), 3)
    assert kept.committed(spark) == 3 and all(len(kept._versions(spark, b)) <= 2 for b in range(4))


@pytest.mark.parametrize("n, first", [(1, True), (2, False), (1000, True), (1000, False)])
def test_affine_scan(n, first):
    x, y, want = np.random.default_rng(n).normal(size=n), 3.5, []
    for i, v in enumerate(x):
        y = v if first and i == 0 else 0.9 * y + 0.1 * v
        want.append(y)
    np.testing.assert_allclose(J.affine_scan(x, 0.1, first, 3.5), want, rtol=1e-12, atol=1e-15)


def slow_averages(close: list, span: int, period: int) -> list:
    out, ema, up, down = [], None, 0.0, 0.0
    for i, c in enumerate(close):
        ema = c if i == 0 else ema + 2.0 / (span + 1) * (c - ema)
        if i:
            gain, loss = max(c - close[i - 1], 0.0), max(close[i - 1] - c, 0.0)
            up, down = (gain, loss) if i == 1 else (up + (gain - up) / period, down + (loss - down) / period)
        out.append((ema if i + 1 >= span else None, (100.0 if down == 0 else 100 - 100 / (1 + up / down)) if i + 1 > period else None))
    return out


def bars(n: int = 60) -> pd.DataFrame:
    rng = np.random.default_rng(8)
    return pd.DataFrame({"symbol": np.tile(["a", "b", "c"], n), "ts": np.repeat(pd.date_range("2024-01-01", periods=n), 3), "close": np.round(rng.normal(100, 3, 3 * n), 2)})


def averages_of(df) -> dict:
    return {(r["symbol"], r["ts"].to_pydatetime() if hasattr(r["ts"], "to_pydatetime") else r["ts"]): (r["ema"], r["rsi"]) for r in df.collect()}


def assert_averages(found, pdf: pd.DataFrame, span: int = 5, period: int = 4) -> None:
    got = averages_of(found)
    assert len(got) == len(pdf)
    for symbol, rows in pdf.groupby("symbol"):
        for ts, want in zip(rows["ts"], slow_averages(rows["close"].tolist(), span, period)):
            for a, b in zip(got[symbol, ts.to_pydatetime()], want):
                assert (a is None or np.isnan(a)) if b is None else abs(a - b) < 1e-9


def test_averages_over_triggers_and_their_end(spark, tmp_path):
    pdf, schema = bars(), "symbol string, ts timestamp_ntz, close double"
    df = spark.createDataFrame(pdf).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")
    early = df.where("ts < '2024-01-20'")
    early.repartition(3).write.parquet(str(tmp_path / "a"))
    df.where("ts >= '2024-01-20'").coalesce(1).write.parquet(str(tmp_path / "b"))
    both = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    with J.keyed_state(spark):
        stream = J.running_averages(both.parquet(str(tmp_path / "a")), 5, 4)
        J.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "log"))
        df.where("ts >= '2024-01-20'").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        J.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "log"))  # the same stream later, from its checkpoint
        assert_averages(spark.read.parquet(str(tmp_path / "out")), pdf)

        known = J.averages_state(early, 5, 4)
        J.run_to_table(J.running_averages(both.parquet(str(tmp_path / "b")), 5, 4, initial=known), str(tmp_path / "out2"), str(tmp_path / "log2"))
        want = averages_of(spark.read.parquet(str(tmp_path / "out")).where("ts >= '2024-01-20'"))
        got = averages_of(spark.read.parquet(str(tmp_path / "out2")))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], equal_nan=True) for k in want)

        early.coalesce(1).write.parquet(str(tmp_path / "c"))
        short = J.running_averages(both.parquet(str(tmp_path / "c")), 5, 4, keep_days=1e-8)
        J.run_to_table(short, str(tmp_path / "out3"), str(tmp_path / "log3"))
        time.sleep(0.1)
        df.where("ts >= '2024-01-20'").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        J.run_to_table(short, str(tmp_path / "out3"), str(tmp_path / "log3"))
        assert_averages(spark.read.parquet(str(tmp_path / "out3")).where("ts >= '2024-01-20'"), pdf[pdf.ts >= "2024-01-20"])  # as if it began there
    assert_averages(spark.createDataFrame(pd.concat([  # pieces of a batch change nothing
        pd.DataFrame({"symbol": s, "ts": r["ts"], **dict(zip(("ema", "rsi"), pieces(r["close"].to_numpy())))}) for s, r in pdf.groupby("symbol")])), pdf)


def pieces(close: np.ndarray) -> tuple:
    state, parts = (0.0, 0, 0.0, 0.0, 0.0), []
    for at in range(0, len(close), 7):
        *found, state = J.advance(close[at : at + 7], state, 5, 4)
        parts.append(found)
    return tuple(np.concatenate(p) for p in zip(*parts))
