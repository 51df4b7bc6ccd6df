"""Return series keyed by id: compounding, moments, drawdowns, wealth, correlation and slope.

A series has one row per (key, idx); `idx` counts from 0 in time order. Per-key windows see one row
per trading day, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import month_start
from ..functions.windows import over, running

KEY = ("series_id",)


def compounded(ret: Column) -> Column:
    """Compounded gain of a group of returns."""
    return F.product(1.0 + ret) - 1.0


def monthly_difference(df: DataFrame, a: str, b: str, keys: Sequence[str] = KEY, dt: str = "dt") -> DataFrame:
    """Per calendar month, compounded growth of one daily series minus that of another, renumbered."""
    monthly = df.groupBy(*keys, month_start(dt).alias("dt")).agg(
        (F.product(1.0 + F.col(a)) - F.product(1.0 + F.col(b))).alias("ret")
    )
    return monthly.withColumn("idx", F.row_number().over(over(keys, "dt")) - 1)


def growth_summary(
    series: DataFrame, keys: Sequence[str] = KEY, dt: str = "dt", per_year: float = 252.0
) -> DataFrame:
    """Compounded gain, yearly growth on a 365-day year (-1 if wiped out), yearly deviation and Sharpe."""
    years = F.greatest(F.datediff(F.max(dt), F.min(dt)) / 365.0, F.lit(1e-12))
    agg = series.groupBy(*keys).agg(
        compounded(F.col("ret")).alias("total_gain"), years.alias("_years"),
        F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_std"),
    )
    wiped = F.col("total_gain") <= -1.0
    return agg.select(
        *keys, "total_gain",
        F.when(wiped, -1.0).otherwise(F.pow(1.0 + F.col("total_gain"), 1.0 / F.col("_years")) - 1.0).alias("cagr"),
        (F.col("_std") * per_year**0.5).alias("ann_vol"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * per_year**0.5).alias("ann_sharpe"),
    )


def return_moments(series: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Count, mean, sample deviation, Sharpe, population skewness and non-excess kurtosis, with a status."""
    agg = series.groupBy(*keys).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
        F.var_pop("ret").alias("_var"), F.skewness("ret").alias("_skew"), F.kurtosis("ret").alias("_kurt"),
    )
    ok = (F.col("n") >= 2) & (F.col("_var") > 0)
    status = F.when(F.col("n") < 2, "too_short").when(ok, "ok").otherwise("zero_variance")
    return agg.select(
        *keys, "n", "mean", "std", status.alias("status"),
        F.when(ok, F.col("mean") / F.col("std")).alias("sr"),
        F.when(ok, F.col("_skew")).alias("skew"), F.when(ok, F.col("_kurt") + 3.0).alias("kurt"),
    )


def wealth(series: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Running wealth of one unit."""
    return series.withColumn("wealth", F.product(1.0 + F.col("ret")).over(running(keys, "idx")))


def wealth_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Wealth of one table of series over that of another, matched by key and position."""
    left = wealth(a, keys).select(*keys, "idx", "dt", F.col("wealth").alias("wealth_a"))
    right = wealth(b, keys).select(*keys, "idx", F.col("wealth").alias("wealth_b"))
    return left.join(right, [*keys, "idx"]).withColumn("ratio", F.col("wealth_a") / F.col("wealth_b"))


def max_drawdown(
    path: DataFrame, value: str, order: Sequence[str] = ("idx",), keys: Sequence[str] = KEY, floor: float | None = 1.0
) -> DataFrame:
    """Largest relative fall of a positive path below its running peak; the peak starts at `floor`
    or, without one, at the first value."""
    peak = F.max(value).over(running(keys, *order))
    peak = peak if floor is None else F.greatest(peak, F.lit(floor))
    fall = F.greatest(1.0 - F.col(value) / F.nullif(peak, F.lit(0.0)), F.lit(0.0))
    return path.withColumn("_fall", fall).groupBy(*keys).agg(F.max("_fall").alias("max_drawdown"))


def additive_drawdown(
    series: DataFrame, value: str, order: Sequence[str] = ("idx",), keys: Sequence[str] = KEY
) -> DataFrame:
    """Largest fall of a running sum below its running peak, the peak starting at zero."""
    w = running(keys, *order)
    total = series.withColumn("_sum", F.sum(value).over(w))
    fall = F.greatest(F.max("_sum").over(w), F.lit(0.0)) - F.col("_sum")
    return total.withColumn("_fall", fall).groupBy(*keys).agg(F.max("_fall").alias("max_drawdown"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation as an aggregate, zero if either side is constant."""
    varies = (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return F.when(varies, F.corr(a, b)).otherwise(0.0)


def redundancy(a: DataFrame, b: DataFrame, per_year: float = 252.0, min_rows: int = 126) -> DataFrame:
    """Aligned days, correlation and 50/50 combination Sharpe of every series of `a` with the same-named
    or only series of `b` (matched by date); zeros below the minimum overlap."""
    keys = [k for k in KEY if k in b.columns]
    right = b.select(*keys, "dt", F.col("ret").alias("ret_b"))
    combo = 0.5 * F.col("ret") + 0.5 * F.col("ret_b")
    joined = a.join(right, [*keys, "dt"]).withColumn("_combo", combo)
    agg = joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_aligned"), pearson(F.col("ret"), F.col("ret_b")).alias("corr"),
        (F.avg("_combo") / F.nullif(F.stddev_samp("_combo"), F.lit(0.0)) * per_year**0.5).alias("combo_ann_sharpe"),
    )
    enough = F.col("n_aligned") >= min_rows
    return agg.select(
        "series_id", "n_aligned", F.when(enough, F.col("corr")).otherwise(0.0).alias("corr"),
        F.when(enough, F.col("combo_ann_sharpe")).otherwise(0.0).alias("combo_ann_sharpe"),
    )


def linear_trend(series: DataFrame, keys: Sequence[str] = KEY, per_year: float = 365.0) -> DataFrame:
    """Least-squares slope per year and intercept of each series on elapsed calendar time."""
    first = F.min("dt").over(over(keys))
    timed = series.withColumn("years", F.datediff("dt", first) / per_year)
    return timed.groupBy(*keys).agg(
        F.regr_slope("ret", "years").alias("slope"), F.regr_intercept("ret", "years").alias("intercept")
    )
