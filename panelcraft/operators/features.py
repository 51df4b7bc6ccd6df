"""Technical indicators on daily bars, all per symbol, backward-looking, NULL until their window is full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import ordered
from ..functions.calendar import week_end
from ..functions.ema import span, wilder, with_ema
from ..functions.windows import over, rolling, trailing, when_full

# Indicator windows.
SMA_LENGTHS = (3, 5, 10, 20, 50, 100, 200)
FAST, SLOW, SIGNAL = 12, 26, 9
OSCILLATOR, SMOOTH = 14, 3
BAND, BAND_WIDTH = 20, 2.0

SIGNALS = (
    "rsi", "stochK", "stochD", "stochRSI", "cci",
    *[f"sma_{n}d" for n in SMA_LENGTHS], "macd", "macd_diff_signal",
    *[f"volsma_{n}d" for n in SMA_LENGTHS], "volmacd", "volmacd_diff_signal", "chaikin",
    "boll_mid", "boll_high", "boll_low", "boll_width",
)
_KEY, _ORDER = ["symbol"], "date"


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _roll(c: str | Column, op: str, n: int) -> Column:
    return rolling(c, op, _KEY, _ORDER, n)


def _in_range(value: Column, low: Column, high: Column, scale: float = 1.0) -> Column:
    return F.when(high - low > 0, scale * (value - low) / (high - low))


def sma_ratios(daily: DataFrame) -> DataFrame:
    """Moving averages of price and volume over their current value."""
    inputs = {"sma": "close", "volsma": "dollar_volume"}
    return daily.withColumns({
        f"{name}_{n}d": _ratio(_roll(c, "mean", n), F.col(c)) for name, c in inputs.items() for n in SMA_LENGTHS
    })


def oscillators(daily: DataFrame) -> DataFrame:
    """Percentage price and volume oscillators and their distance from their own signal line."""
    pairs = {"macd": "close", "volmacd": "dollar_volume"}
    averages = {}
    for name, c in pairs.items():
        averages |= {f"_fast_{name}": span(c, FAST), f"_slow_{name}": span(c, SLOW)}
    out = with_ema(daily, averages, _KEY, _ORDER)
    out = out.withColumns({n: _ratio(F.col(f"_fast_{n}") - F.col(f"_slow_{n}"), F.col(f"_fast_{n}")) for n in pairs})
    out = with_ema(out, {f"_line_{n}": span(n, SIGNAL) for n in pairs}, _KEY, _ORDER)
    out = out.withColumns({f"{n}_diff_signal": F.col(n) - F.col(f"_line_{n}") for n in pairs})
    return out.drop(*[f"_{kind}_{n}" for kind in ("fast", "slow", "line") for n in pairs])


def relative_strength(daily: DataFrame) -> DataFrame:
    """Wilder's index, 100 where there are no losses, and its place in its own recent range."""
    move = F.col("close") - F.lag("close").over(over(_KEY, _ORDER))
    out = daily.withColumn("_move", move)
    out = out.withColumns({
        "_gain": F.when(F.col("_move").isNotNull(), F.greatest(F.col("_move"), F.lit(0.0))),
        "_loss": F.when(F.col("_move").isNotNull(), F.greatest(-F.col("_move"), F.lit(0.0))),
    })
    out = with_ema(out, {"_up": wilder("_gain", OSCILLATOR), "_down": wilder("_loss", OSCILLATOR)}, _KEY, _ORDER)
    strength = 100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_down"))
    out = out.withColumn("rsi", F.when(F.col("_down") == 0, 100.0).otherwise(strength))
    place = _in_range(F.col("rsi"), _roll("rsi", "min", OSCILLATOR), _roll("rsi", "max", OSCILLATOR))
    return out.withColumn("stochRSI", place).drop("_move", "_gain", "_loss", "_up", "_down")


def ranges(daily: DataFrame) -> DataFrame:
    """Stochastic %K and %D, commodity channel index, money flow and bands."""
    out = daily.withColumn(
        "stochK", _in_range(F.col("close"), _roll("low", "min", OSCILLATOR), _roll("high", "max", OSCILLATOR), 100.0)
    )
    out = out.withColumn("stochD", _roll("stochK", "mean", SMOOTH))

    out = out.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    w = trailing(_KEY, _ORDER, BAND)
    out = out.withColumns({"_mid": _roll("_tp", "mean", BAND), "_seen": when_full(F.collect_list("_tp").over(w), F.col("_tp"), w, BAND)})
    spread = F.aggregate("_seen", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mid"))) / BAND
    out = out.withColumn("_spread", spread)
    out = out.withColumn("cci", F.when(F.col("_spread") > 0, (F.col("_tp") - F.col("_mid")) / (0.015 * F.col("_spread"))))

    width = F.col("high") - F.col("low")
    lean = F.when(width > 0, (2.0 * F.col("close") - F.col("low") - F.col("high")) / width).otherwise(0.0)
    out = out.withColumn("_flow", lean * F.col("dollar_volume"))
    volume = _roll("dollar_volume", "sum", BAND)
    out = out.withColumn("chaikin", F.when(volume > 0, _roll("_flow", "sum", BAND) / volume))

    out = out.withColumns({"_sma": _roll("close", "mean", BAND), "_dev": _roll("close", "std", BAND)})
    out = out.withColumns({
        "boll_mid": _ratio(F.col("_sma"), F.col("close")),
        "boll_high": _ratio(F.col("_sma") + BAND_WIDTH * F.col("_dev"), F.col("close")),
        "boll_low": _ratio(F.col("_sma") - BAND_WIDTH * F.col("_dev"), F.col("close")),
    })
    out = out.withColumn("boll_width", F.when(F.col("_sma") > 0, (F.col("boll_high") - F.col("boll_low")) / F.col("boll_mid")))
    return out.drop("_tp", "_mid", "_seen", "_spread", "_flow", "_sma", "_dev")


def _recursive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, before, place = ordered.Keys(), ordered.Previous(), ordered.Place(OSCILLATOR)
    lines = {
        name: (c, *[ordered.Average(e.alpha, e.min_obs) for e in (span(c, FAST), span(c, SLOW), span(name, SIGNAL))])
        for name, c in {"macd": "close", "volmacd": "dollar_volume"}.items()
    }
    gains, losses = (ordered.Average(e.alpha, e.min_obs) for e in (wilder("_gain", OSCILLATOR), wilder("_loss", OSCILLATOR)))
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = keys.advance(batch.column("symbol"))
        inputs = {c: ordered.Column.of(batch.column(c)) for c in ("close", "dollar_volume")}
        made = {}
        for name, (c, fast, slow, signal) in lines.items():
            quick = fast.of(inputs[c], starts)
            made[name] = (quick - slow.of(inputs[c], starts)).over(quick)
            made[f"{name}_diff_signal"] = made[name] - signal.of(made[name], starts)
        move = inputs["close"] - before.of(inputs["close"], starts)
        up = gains.of(ordered.Column(np.maximum(move.value, 0.0), move.here), starts)
        down = losses.of(ordered.Column(np.maximum(-move.value, 0.0), move.here), starts)
        strength = up.over(down)  # 100 where there are no losses
        made["rsi"] = ordered.Column(np.where(strength.here, 100.0 - 100.0 / (1.0 + strength.value), 100.0), up.here)
        made["stochRSI"] = place.of(made["rsi"])
        kept = [c for c in batch.schema.names if c not in inputs]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), *(x.arrow() for x in made.values())], names=[*kept, *made]
        )


def recursive_signals(rows: DataFrame) -> DataFrame:
    """Replace close and dollar_volume by the six signals that rest on recursive averages.

    Rows must be clustered by symbol and sorted by symbol and date within partitions. All averages, of all
    symbols of a batch, come from one pass in that order; a symbol may span any number of batches, and only a few
    numbers per average are held between them. NULL inputs are skipped.
    """
    names = ("macd", "macd_diff_signal", "volmacd", "volmacd_diff_signal", "rsi", "stochRSI")
    kept = [f for f in rows.schema.fields if f.name not in ("close", "dollar_volume")]
    return rows.mapInArrow(_recursive, T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)]))


def daily_features(daily: DataFrame) -> DataFrame:
    """All 28 signals per (symbol, date): one exchange and one sort by symbol and date carry every window and recursion.

    The windows are heavy per byte, so the exchange keeps every configured partition instead of letting
    small ones be merged by size.
    """
    parts = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    daily = daily.select("symbol", "date", "close", "high", "low", "dollar_volume").repartition(parts, "symbol")
    done = ranges(sma_ratios(daily)).drop("high", "low").sortWithinPartitions("symbol", "date")
    return recursive_signals(done).select("symbol", "date", *SIGNALS)


def weekly_features(features: DataFrame) -> DataFrame:
    """Each signal at the last bar of every week."""
    present = [c for c in features.columns if c not in ("symbol", "date")]
    last = features.groupBy("symbol", week_end("date").alias("week_end")).agg(F.max_by(F.struct(*present), "date").alias("_s"))
    return last.select("week_end", "symbol", *[F.col(f"_s.{c}").alias(c) for c in present])
