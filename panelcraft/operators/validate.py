"""Rules on input tables. Each check returns the offending rows; `require_none` makes it fatal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.windows import over


class DataRuleError(ValueError):
    """A table breaks a rule it must satisfy."""


def require_none(violations: DataFrame, message: str) -> None:
    """Raise if there is any violation, showing the first."""
    first = violations.take(1)
    if first:
        raise DataRuleError(f"{message}: first offending row {first[0].asDict()}")


def _bad_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def ohlc_violations(daily: DataFrame) -> DataFrame:
    """Bars with a non-positive low or close, a negative volume, or a close outside [low, high]."""
    rule = (
        F.when(_bad_number("close") | _bad_number("high") | _bad_number("low") | _bad_number("dollar_volume"), "missing_value")
        .when(F.col("low") <= 0, "non_positive_low")
        .when(F.col("close") <= 0, "non_positive_close")
        .when(F.col("dollar_volume") < 0, "negative_volume")
        .when((F.col("high") < F.col("low")) | ~F.col("close").between(F.col("low"), F.col("high")), "inconsistent_bar")
    )
    return daily.withColumn("rule", rule).filter("rule IS NOT NULL")


def index_bar_violations(bars: DataFrame) -> DataFrame:
    """Index bars whose four prices are not all positive, or whose open or close leaves [low, high]."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    rule = (
        F.when(reduce(or_, [_bad_number(c) for c in ("open", "high", "low", "close")]), "missing_value")
        .when(F.least(*prices) <= 0, "non_positive_price")
        .when(F.greatest(*prices) > F.col("high"), "above_high")
        .when(F.least(*prices) < F.col("low"), "below_low")
    )
    return bars.withColumn("rule", rule).filter("rule IS NOT NULL")


def settled_conflicts(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Instants at which settled rows of one instrument disagree on the rate."""
    return (
        events.filter("realized").groupBy(*keys, "ts")
        .agg(F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.count(F.lit(1)).alias("n_rows"))
        .filter("min_rate <> max_rate")
    )


def interval_diagnostics(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Stamped interval (mode, smallest on ties), median observed gap, and share of gaps over 25 % off."""
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(over(keys, "ts")).cast("timestamp"))) / 3.6e9
    gaps = events.withColumn("_gap", gap)
    stamped = (
        gaps.groupBy(*keys)
        .agg(
            F.mode("interval_hours", True).cast("double").alias("stamped_hours"),
            F.median("_gap").alias("median_gap_hours"),
            F.count(F.lit(1)).alias("n_events"),
            F.count("_gap").alias("n_gaps"),
        )
    )
    off = F.abs(F.col("_gap") - F.col("stamped_hours")) > 0.25 * F.col("stamped_hours")
    counted = (
        gaps.groupBy(*keys, "_gap").agg(F.count("_gap").alias("_n"))
        .join(stamped, list(keys)).groupBy(*keys)
        .agg(F.sum(F.when(off, F.col("_n")).otherwise(0)).alias("_off"))
    )
    return stamped.join(counted, list(keys)).select(
        *keys, "stamped_hours", "median_gap_hours", "n_events",
        F.when(F.col("n_gaps") > 0, F.col("_off") / F.col("n_gaps")).otherwise(0.0).alias("mismatch_fraction"),
    )


def interval_mislabels(diagnostics: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Instruments of three or more events whose median gap is far from the stamped interval."""
    ratio = F.col("median_gap_hours") / F.col("stamped_hours")
    return (
        diagnostics.filter("n_events >= 3 AND stamped_hours > 0 AND median_gap_hours > 0")
        .withColumn("gap_ratio", ratio).filter(~F.col("gap_ratio").between(low, high))
    )


def calendar_gaps(daily: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows that do not follow the day before, or that have no close."""
    step = F.datediff("date", F.lag("date").over(over(keys, "date")))
    return daily.withColumn("gap_days", step).filter((F.col("gap_days") != 1) | F.col("close").isNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def panel_report(panel: DataFrame, key: str, positive: Sequence[str], min_rows: int) -> DataFrame:
    """Row count, repeated keys, NULLs or NaNs, and non-positive values of a panel, one row per rule."""
    missing = [c for c in (key, *positive) if c not in panel.columns]
    if missing:
        raise DataRuleError(f"panel lacks columns {missing}")
    numbers = [c for c, t in panel.dtypes if t in ("double", "float")]
    bad = [F.count_if(_bad_number(c)) for c in numbers]
    per_key = panel.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        sum(bad, F.lit(0)).alias("_missing"),
        sum([F.count_if(F.col(c) <= 0) for c in positive], F.lit(0)).alias("_negative"),
    )
    totals = per_key.agg(
        F.greatest(F.lit(min_rows) - F.sum("_n"), F.lit(0)).cast("bigint").alias("too_few_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_key"),
        F.sum("_missing").cast("bigint").alias("missing_value"),
        F.sum("_negative").cast("bigint").alias("non_positive"),
    )
    return totals.unpivot([], ["too_few_rows", "repeated_key", "missing_value", "non_positive"], "rule", "n")


def option_violations(chain: DataFrame, prefix: str) -> DataFrame:
    """Option rows with a foreign symbol, unknown type, bad strike or underlying, or absurd moneyness."""
    moneyness = F.col("strike") / F.nullif(F.col("underlying"), F.lit(0.0))
    rule = (
        F.when(~F.coalesce(F.col("instrument").startswith(prefix), F.lit(False)), "foreign_symbol")
        .when(~F.coalesce(F.col("type").isin("call", "put"), F.lit(False)), "unknown_type")
        .when(F.coalesce(F.col("strike") <= 0, F.lit(True)), "non_positive_strike")
        .when(F.coalesce(F.col("underlying") <= 0, F.lit(True)), "non_positive_underlying")
        .when(~moneyness.between(0.01, 100.0), "absurd_moneyness")
    )
    return chain.withColumn("rule", rule).filter("rule IS NOT NULL")


def is_synthetic_index(name: Column) -> Column:
    """Whether an underlying index is a synthetic one."""
    return name.startswith("SYN.")


def label_contract(labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per series: rows out of time order, missing horizons, horizons before their row, equal types."""
    same = dict(labels.dtypes)["dt"] == dict(labels.dtypes)["horizon"]
    w = over(keys, "idx")
    return (
        labels.withColumn("_back", F.col("dt") < F.lag("dt").over(w)).groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_back").alias("n_unsorted"),
            F.count_if(F.col("horizon").isNull()).alias("n_null"),
            F.count_if(F.col("horizon") < F.col("dt")).alias("n_backward"),
        )
        .withColumn("same_type", F.lit(same))
    )


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the side they come from."""
    only_a = a.exceptAll(b).withColumn("side", F.lit("left"))
    return only_a.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def entry_range_gaps(obs: DataFrame, horizon: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entries whose whole holding window exists but lacks a price or a rate; tail rows are not errors."""
    w = over(keys, "idx")
    ahead = w.rowsBetween(1, horizon)
    missing = (
        F.col("spot_close").isNull() | F.col("perp_close").isNull()
        | F.lead("spot_close", horizon).over(w).isNull() | F.lead("perp_close", horizon).over(w).isNull()
        | (F.count("funding_rate").over(ahead) < horizon)
    )
    return (
        obs.withColumn("_exit", F.lead("idx", horizon).over(w)).withColumn("_missing", missing)
        .filter("_exit IS NOT NULL AND _missing").select(*keys, "idx")
    )
