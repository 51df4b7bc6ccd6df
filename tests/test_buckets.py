"""Many symbols in one call: running averages by buckets of symbols equal those of each symbol alone."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcraft.streaming import jobs as J

FRESH = (0.0, 0, 0.0, 0.0, 0.0)


class Store:
    """A bucket's state, and how often it was visited."""

    def __init__(self) -> None:
        self.value, self.visits = None, 0

    def getValueState(self, *_):
        return self

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value, self.visits = value, self.visits + 1


class Clock:
    def __init__(self, ms: int) -> None:
        self.ms = ms

    def getCurrentProcessingTimeInMs(self) -> int:
        return self.ms


def prices(symbols: list, days: range, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(np.round(rng.normal(100, 3), 2))) for d in days for s in symbols]
    return pd.DataFrame(rows, columns=["symbol", "ts", "close"]).sample(frac=1, random_state=seed)


def alone(pdf: pd.DataFrame, symbol, state: tuple = FRESH) -> tuple:
    mine = pdf[pdf.symbol.isna()] if symbol is None else pdf[pdf.symbol == symbol]
    return J.advance(mine.sort_values("ts")["close"].to_numpy(), state, 5, 4)


def step(run: J.RunningAverages, pdf: pd.DataFrame, ms: int) -> pd.DataFrame:
    return pd.concat(run.handleInputRows((0,), iter([pdf[:5], pdf[5:11], pdf[11:]]), Clock(ms)))


def same(out: pd.DataFrame, pdf: pd.DataFrame, symbol, state: tuple = FRESH) -> tuple:
    ema, rsi, after = alone(pdf, symbol, state)
    mine = (out[out.symbol.isna()] if symbol is None else out[out.symbol == symbol]).sort_values("ts")
    np.testing.assert_allclose(mine["ema"], ema, rtol=1e-12)
    np.testing.assert_allclose(mine["rsi"], rsi, rtol=1e-9)
    return after


def test_one_visit_serves_a_bucket(monkeypatch):
    monkeypatch.setattr(J, "PIECE", 7)  # pieces that end inside a symbol
    names, store = [*"abcdefgh", None, ""], Store()
    run = J.RunningAverages(5, 4, 1000)
    run.init(store)
    first, second = prices(names, range(9), 1), prices([*"abc", None, "new"], range(9, 20), 2)
    first.loc[first.index[:1], "close"] = np.nan  # stays with its own symbol
    step_one = step(run, first, 100)
    states = {s: same(step_one, first, s) for s in names}
    assert store.visits == 1 and len(store.value[0]) == len(names)
    out = step(run, second, 600)
    for s in [*"abc", None, "new"]:
        same(out, second, s, states.get(s, FRESH))
    # a, b, c were heard of at 600, the others at 100: at 1200 only those are forgotten
    third = prices(["a", "h"], range(20, 30), 3)
    out = step(run, third, 1200)
    kept = alone(second, "a", states["a"])[2]
    same(out, third, "a", kept)
    same(out, third, "h")
    assert sorted(map(str, store.value[0])) == ["None", "a", "b", "c", "h", "new"]


def test_initial_states_in_parts():
    store, first, more = Store(), prices([*"abcd"], range(9), 4), prices([*"abcde"], range(9, 20), 5)
    run = J.RunningAverages(5, 4, None)
    run.init(store)
    states = {s: alone(first, s)[2] for s in "abcd"}
    given = pd.DataFrame([(s, *v) for s, v in states.items()], columns=["symbol", *J.FIELDS])
    run.handleInitialState((0,), given[:2], Clock(1))
    run.handleInitialState((0,), given[1:], Clock(1))
    out = step(run, more, 2)
    for s in "abcde":
        same(out, more, s, states.get(s, FRESH))


def test_state_of_a_table(spark):
    """Large whole numbers and null as symbols, a symbol longer than a batch."""
    big = 2**60 + 1
    pdf = pd.concat([prices([big, big + 1, 7], range(40), 6), prices([None], range(40), 7)]).astype({"symbol": object})
    rows = [(s, t.to_pydatetime(), c) for s, t, c in pdf.itertuples(index=False)] + [(9, dt.datetime(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {r["symbol"]: tuple(r)[1:] for r in J.averages_state(df, 5, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == {big, big + 1, 7, None, 9} and got[9] == (5.0, 1, 5.0, 0.0, 0.0)
    for s in (big, big + 1, 7, None):
        mine = pdf[[x is None if s is None else x == s for x in pdf.symbol]].sort_values("ts")
        np.testing.assert_allclose(got[s], J.advance(mine["close"].to_numpy(), FRESH, 5, 4)[2], rtol=1e-12)


def test_stream_of_numbered_symbols(spark, tmp_path):
    big, schema = 2**60 + 1, "symbol long, ts timestamp_ntz, close double"
    pdf = pd.concat([prices([big, big + 1, 7, 8], range(12), 8), prices([None], range(12), 9)]).astype({"symbol": object})
    df = spark.createDataFrame([(s, t.to_pydatetime(), c) for s, t, c in pdf.itertuples(index=False)], schema)
    df.where(F.col("ts") < "2024-01-08").coalesce(1).write.parquet(str(tmp_path / "a"))
    df.where(F.col("ts") >= "2024-01-08").coalesce(1).write.parquet(str(tmp_path / "b"))
    with J.keyed_state(spark):
        known = J.averages_state(spark.read.schema(schema).parquet(str(tmp_path / "a")), 5, 4)
        stream = J.running_averages(spark.readStream.schema(schema).parquet(str(tmp_path / "b")), 5, 4, initial=known, buckets=2)
        J.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 25 and {r["symbol"] for r in got} == {big, big + 1, 7, 8, None}
    for s in (big, big + 1, 7, 8, None):
        mine = pdf[[x is None if s is None else x == s for x in pdf.symbol]].sort_values("ts")
        ema, rsi, _ = J.advance(mine["close"].to_numpy(), FRESH, 5, 4)
        have = sorted((r["ts"], r["ema"], r["rsi"]) for r in got if r["symbol"] == s)
        np.testing.assert_allclose([h[1:] for h in have], np.stack([ema, rsi], 1)[7:], rtol=1e-12)
