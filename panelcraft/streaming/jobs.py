"""Streaming jobs: freshest quote per window, settled events, recursive averages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .upsert import UpsertTable


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a table of files, exactly once, and stop.

    A stream whose state expires by the clock has a batch to run at any time. Two in a row without rows end it: the first
    may be one that the last stop cut short.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(0.2):
            last = query.recentProgress[-2:]
            if len(last) == 2 and not any(p["numInputRows"] for p in last):
                break
    finally:
        query.stop()


def run_to_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and stop; each micro-batch leaves the rows it changed in a folder of its own.

    Windows that are still open are there too. A batch that runs again after a failure replaces its folder.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    query.trigger(availableNow=True).start().awaitTermination()


def current_rows(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each key in what `run_to_updates` has left; `batch` is the folder's number."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def freshest_quotes(quotes: DataFrame, window: str = "1 hour", lateness: str = "30 seconds") -> DataFrame:
    """Last quote of every instrument in each time window; rows later than `lateness` are dropped."""
    rest = [c for c in quotes.columns if c not in ("ts", "instrument")]
    agg = quotes.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "instrument").agg(
        F.max_by(F.struct("ts", *rest), F.struct("ts", "ingest")).alias("_q")
    )
    return agg.select("instrument", F.col("w.end").alias("window_end"), "_q.ts", *[F.col(f"_q.{c}").alias(c) for c in rest])


def latest_as_of(windows: DataFrame, quotes: DataFrame, as_of: str, window: str = "1 hour") -> DataFrame:
    """Each instrument's freshest quote at an instant: of the windows closed by then, or of the open one.

    A window only knows its last quote, which may come after the instant, so the window around the instant is read
    from the quotes themselves: one window's worth of rows, however long the history is.
    """
    instant = F.lit(as_of).cast("timestamp")
    rest = [c for c in quotes.columns if c != "instrument"]
    closed = windows.filter(F.col("window_end") <= instant).select("instrument", *rest)
    recent = quotes.filter((F.col("ts") <= instant) & (F.col("ts") > instant - F.expr(f"INTERVAL {window}")))
    inside = recent.filter(F.window("ts", window)["end"] > instant).select("instrument", *rest)
    picked = closed.unionByName(inside).groupBy("instrument").agg(F.max_by(F.struct(*rest), F.struct("ts", "ingest")).alias("_q"))
    return picked.select("instrument", *[F.col(f"_q.{c}").alias(c) for c in rest])


def settled_parts(events: DataFrame) -> DataFrame:
    """Events in the mergeable form of `settled_table`, one row per event."""
    settled = F.when(F.col("realized"), F.col("rate"))
    return events.select(
        "symbol", "ts", F.struct(F.col("realized").cast("int").alias("settled"), (-F.col("ingest")).alias("age"), "rate").alias("best"),
        settled.alias("low"), settled.alias("high"), F.lit(1).cast("long").alias("n_rows"))


def settled_table(path: str, buckets: int = 64) -> UpsertTable:
    """One row per (symbol, ts): a settled row replaces an estimate, the earliest ingest wins among equals.

    Each part is a maximum, minimum or sum, so events may come in any order and as late as they like.
    """
    merge = {"best": F.max("best"), "low": F.min("low"), "high": F.max("high"), "n_rows": F.sum("n_rows")}
    return UpsertTable(path, ("symbol", "ts"), merge, buckets)


def settled_rows(table: DataFrame) -> DataFrame:
    """What `settled_table` stands for; disagreeing settled rates are flagged."""
    return table.select(
        "symbol", "ts", F.col("best.rate").alias("rate"), (F.col("best.settled") == 1).alias("realized"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"), "n_rows")


def affine_scans(x: np.ndarray, alpha: float, fresh: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """y[t] = (1 - alpha) * y[t-1] + alpha * x[t] for many series laid end to end.

    `place` is a row's number within its series. A series goes on from `start`, or begins with y[0] = x[0] where it is
    `fresh`. Steps are affine maps; they are composed over spans of 1, 2, 4, ... steps of one series, so there is no loop
    over rows or series, no weight grows and nothing of one series reaches the next.
    """
    keep, add = np.full(len(x), 1.0 - alpha), alpha * x
    begin = fresh & (place == 0)
    keep[begin], add[begin] = 0.0, x[begin]
    span, rows = 1, np.flatnonzero(place >= 1)
    while len(rows):
        add[rows] += keep[rows] * add[rows - span]
        keep[rows] = keep[rows] * keep[rows - span]
        span *= 2
        rows = rows[place[rows] >= span]
    return keep * start + add


def affine_scan(x: np.ndarray, alpha: float, first: bool, start: float) -> np.ndarray:
    """`affine_scans` of one series."""
    return affine_scans(x, alpha, np.full(len(x), first), np.full(len(x), start), np.arange(len(x)))


#: What is remembered of a symbol: average, values seen, last value, average gain and loss.
AVERAGES_STATE = "ema DOUBLE, n BIGINT, last DOUBLE, up DOUBLE, down DOUBLE"
FIELDS = ("ema", "n", "last", "up", "down")


def no_states(size: int) -> dict[str, np.ndarray]:
    """The states of symbols that have not been heard of."""
    return {f: np.zeros(size, np.int64 if f == "n" else float) for f in FIELDS}


def advance_each(close: np.ndarray, code: np.ndarray, states: dict[str, np.ndarray], span: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Averages and relative strengths of many symbols' next values; `states` are moved on.

    Rows are in the order of their symbol's code, a symbol's rows in time order; a code is a place in `states`.
    """
    heads = np.flatnonzero(np.diff(code, prepend=-1))
    size = np.diff(heads, append=len(code))
    place = np.arange(len(code)) - np.repeat(heads, size)
    own = code[heads]
    of = {f: np.repeat(v[own], size) for f, v in states.items()}
    n = of["n"]
    averages = affine_scans(close, 2.0 / (span + 1.0), n == 0, of["ema"], place)
    before = np.concatenate([close[:1], close[:-1]])
    before[heads] = np.where(n[heads] > 0, of["last"][heads], close[heads])
    step = close - before
    late = n + place > 0  # the first value has no step
    ups, downs = np.full(len(close), np.nan), np.full(len(close), np.nan)
    for out, moves, field in ((ups, np.maximum(step, 0.0), "up"), (downs, np.maximum(-step, 0.0), "down")):
        out[late] = affine_scans(moves[late], 1.0 / period, n[late] <= 1, of[field][late], (place - (n == 0))[late])
    seen = n + 1 + place
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.where(downs == 0.0, 100.0, 100.0 - 100.0 / (1.0 + ups / downs))
    ends = heads + size - 1
    two = seen[ends] > 1
    for field, after in zip(FIELDS, (averages[ends], seen[ends], close[ends], np.where(two, ups[ends], 0.0), np.where(two, downs[ends], 0.0))):
        states[field][own] = after
    return np.where(seen >= span, averages, np.nan), np.where(seen > period, strength, np.nan)


def advance(close: np.ndarray, state: tuple, span: int, period: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Averages and relative strengths of one symbol's next values in time order, and the state after them."""
    states = {f: np.array([v]) for f, v in zip(FIELDS, state)}
    found = advance_each(close, np.zeros(len(close), np.int64), states, span, period)
    return *found, tuple(v.item() for v in states.values())


def _instants(ts: np.ndarray) -> np.ndarray:
    """Times in a form that sorts, absent ones last."""
    return ts.astype("datetime64[us]") if ts.dtype == object else ts


class RunningAverages(StatefulProcessor):
    """Recursive average and relative strength per symbol, carried across micro-batches.

    A key is a bucket of symbols, so that a call of Python and a visit of the state store serve many of them. The
    state of a bucket holds one entry per symbol, with the time at which it was last heard of.
    """

    def __init__(self, span: int, period: int, keep_ms: int | None) -> None:
        self.span, self.period, self.keep_ms = span, period, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("averages", BUCKET_STATE, self.keep_ms)

    def _known(self, now: int) -> tuple[list, dict[str, np.ndarray], np.ndarray]:
        """Symbols, states and times of the bucket, without those whose time is over."""
        if not self.state.exists():
            return [], no_states(0), np.zeros(0, np.int64)
        symbols, heard, *values = self.state.get()
        heard = np.array(heard, np.int64)
        live = np.ones(len(heard), bool) if self.keep_ms is None else heard + self.keep_ms > now
        states = {f: np.array(v, like.dtype)[live] for (f, like), v in zip(no_states(0).items(), values)}
        return [s for s, here in zip(symbols, live) if here], states, heard[live]

    def _put(self, symbols: list, states: dict[str, np.ndarray], heard: np.ndarray) -> None:
        self.state.update((symbols, heard.tolist(), *(states[f].tolist() for f in FIELDS)))

    def _joined(self, known: list, new: pd.Series) -> tuple[np.ndarray, list]:
        """The place of each new row's symbol among all symbols, the known ones first, and these."""
        both = np.empty(len(known) + len(new), object)
        both[: len(known)], both[len(known) :] = known, new
        codes, symbols = pd.factorize(both, use_na_sentinel=False)
        return codes[len(known) :], [None if pd.isna(s) else s for s in symbols]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        known, states, heard = self._known(now)
        code, symbols = self._joined(known, initialState["symbol"])
        new = np.flatnonzero((code >= len(known)) & ~pd.Series(code).duplicated().to_numpy())  # in the order of their codes
        states = {f: np.concatenate([v, initialState[f].to_numpy(v.dtype)[new]]) for f, v in states.items()}
        self._put(symbols, states, np.concatenate([heard, np.full(len(new), now)]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known, states, heard = self._known(now)
        parts = [(batch["symbol"], batch["ts"].to_numpy(), batch["close"].to_numpy(dtype=float)) for batch in rows]  # of one trigger
        ts, close = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        code, symbols = self._joined(known, pd.concat([p[0] for p in parts]))
        del parts
        more = len(symbols) - len(known)
        states = {f: np.concatenate([v, none]) for (f, v), none in zip(states.items(), no_states(more).values())}
        heard = np.concatenate([heard, np.zeros(more, np.int64)])
        heard[code] = now
        order, names = np.lexsort((close, _instants(ts), code)), np.array(symbols, object)
        for at in range(0, len(order), PIECE):
            piece = order[at : at + PIECE]
            ema, rsi = advance_each(close[piece], code[piece], states, self.span, self.period)
            yield pd.DataFrame({"symbol": names[code[piece]], "ts": ts[piece], "ema": ema, "rsi": rsi})
        self._put(symbols, states, heard)

    def close(self) -> None:
        pass


#: What is remembered of a bucket of symbols: one entry for each in every list.
BUCKET_STATE = "symbol ARRAY<STRING>, heard ARRAY<BIGINT>, ema ARRAY<DOUBLE>, n ARRAY<BIGINT>, last ARRAY<DOUBLE>, up ARRAY<DOUBLE>, down ARRAY<DOUBLE>"
#: Rows advanced together.
PIECE = 1 << 16
#: A symbol that has been silent for so long starts anew.
KEEP_DAYS = 400
#: Groups of symbols that share a call and a row of state.
BUCKETS = 1024


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """Symbols as text, with their bucket."""
    name = F.col("symbol").cast("string")
    return rows.withColumn("symbol", name).withColumn("_bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)))


def running_averages(
    bars: DataFrame, span: int, period: int = 14, keep_days: float | None = KEEP_DAYS, initial: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Recursive average and relative strength per symbol, carried across micro-batches.

    Input: a stream of (symbol, ts, close); a symbol's rows may come in any order inside a micro-batch and in time order
    between them. Symbols are dealt to a number of buckets, fixed when the stream first starts; a bucket's state is one row,
    with an entry per symbol that ends when the symbol has not been heard of for `keep_days` of processing time.
    `initial` (symbol and the columns of `averages_state`) lets a stream go on where a table ended. A micro-batch's rows
    of one bucket must fit a task: bound the trigger of the source. Start it inside `keyed_state`.
    """
    kind = bars.schema["symbol"].dataType
    output = T.StructType([
        T.StructField("symbol", T.StringType()), T.StructField("ts", bars.schema["ts"].dataType), T.StructField("ema", T.DoubleType()), T.StructField("rsi", T.DoubleType()),
    ])
    keep = None if keep_days is None else max(1, int(keep_days * 86_400_000))
    known = None if initial is None else _bucketed(initial, buckets).groupBy("_bucket")
    rows = _bucketed(bars.select("symbol", "ts", F.col("close").cast("double").alias("close")), buckets)
    out = rows.groupBy("_bucket").transformWithStateInPandas(RunningAverages(span, period, keep), output, "append", "processingTime", known)
    return out.withColumn("symbol", F.col("symbol").cast(kind))


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def _last_states(batches: Iterator[pa.RecordBatch], span: int, period: int) -> Iterator[pa.RecordBatch]:
    """One row per symbol of a sorted partition; the last symbol of a batch waits, for the next may go on with it."""
    waiting, state = None, no_states(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, close = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        place = symbol.dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        states = no_states(len(heads))
        if waiting is not None:
            if _same(waiting[0].as_py(), symbol[0].as_py()):
                for f, v in state.items():
                    states[f][0] = v[0]
            else:
                yield _states_of(waiting, state)
        advance_each(close, np.repeat(np.arange(len(heads)), np.diff(heads, append=len(close))), states, span, period)
        if len(heads) > 1:
            yield _states_of(symbol.take(pa.array(heads[:-1])), {f: v[:-1] for f, v in states.items()})
        waiting, state = symbol.take(pa.array(heads[-1:])), {f: v[-1:].copy() for f, v in states.items()}
    if waiting is not None:
        yield _states_of(waiting, state)


def _states_of(symbols: pa.Array, states: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([symbols, *map(pa.array, states.values())], names=["symbol", *FIELDS])


def averages_state(bars: DataFrame, span: int, period: int = 14) -> DataFrame:
    """The state of `running_averages` at the end of a table of (symbol, ts, close): one row per symbol.

    One exchange, one sort and one pass in that order, so no task holds a symbol's rows together.
    """
    rows = bars.select("symbol", "ts", F.col("close").cast("double").alias("close")).repartition("symbol")
    ordered = rows.sortWithinPartitions("symbol", F.asc_nulls_last("ts"), F.asc_nulls_last("close")).select("symbol", "close")
    kinds = bars.schema["symbol"].dataType.simpleString()
    return ordered.mapInArrow(partial(_last_states, span=span, period=period), f"symbol {kinds}, {AVERAGES_STATE}")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams started in the session keep their state in the store that keyed processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
