"""Cross-sectional spread of carried rates, sort premium, coverage, smoothed medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import annualize_rate, week_end
from ..functions.windows import over
from .asof import carried_days


def funded_cross_section(events: DataFrame, eligible: DataFrame, max_gap_days: int = 3) -> DataFrame:
    """Carried yearly rates of eligible names per day, with the number of names eligible that week."""
    yearly = events.withColumn("annualized", annualize_rate(F.col("rate"), F.col("interval_hours")))
    carried = carried_days(yearly.select("symbol", "ts", "annualized"), "annualized", max_gap_days)
    pairs = eligible.select("week_end", "symbol").distinct()
    counts = pairs.groupBy("week_end").agg(F.count(F.lit(1)).alias("n_eligible"))
    return (
        carried.withColumn("week_end", week_end("date"))
        .join(pairs, ["week_end", "symbol"], "left_semi").join(counts, "week_end")
    )


def daily_dispersion(
    cross: DataFrame, winsor: float = 0.05, n_buckets: int = 5, min_names: int = 5
) -> DataFrame:
    """Per day: interquartile range, deviation, winsorised deviation and next-day sort premium.

    One shuffle by day serves the quantiles, the ranks and the final aggregation.
    """
    day = Window.partitionBy("date")
    ordered = over(["date"], "annualized", "symbol")
    q = F.percentile("annualized", F.array(F.lit(winsor), F.lit(0.25), F.lit(0.75), F.lit(1 - winsor))).over(day)
    size = F.greatest(F.lit(1), F.floor(F.col("n_funded") / n_buckets))
    low, high = F.col("_rank") <= size, F.col("_rank") > F.col("n_funded") - size
    return (
        cross.withColumn("n_funded", F.count(F.lit(1)).over(day)).withColumn("_q", q)
        .withColumn("_rank", F.row_number().over(ordered))
        .withColumn("_clipped", F.least(F.greatest(F.col("annualized"), F.col("_q")[0]), F.col("_q")[3]))
        .filter(F.col("n_funded") >= min_names)
        .groupBy("date").agg(
            F.first("n_eligible").alias("n_eligible"), F.first("n_funded").alias("n_funded"),
            F.first(F.col("_q")[2] - F.col("_q")[1]).alias("iqr"), F.stddev_samp("annualized").alias("std"),
            F.stddev_samp("_clipped").alias("winsor_std"),
            (F.avg(F.when(high, F.col("annualized_next"))) - F.avg(F.when(low, F.col("annualized_next")))).alias("sort_premium"),
        )
    )


def dispersion_series(daily: DataFrame, columns: Sequence[str] = ("iqr", "std", "winsor_std", "sort_premium")) -> DataFrame:
    """The daily measures as series, NULL days left out."""
    long = daily.unpivot(["date"], list(columns), "series_id", "ret").filter("ret IS NOT NULL")
    idx = F.row_number().over(over(["series_id"], "date")) - 1
    return long.select("series_id", idx.alias("idx"), F.col("date").alias("dt"), "ret")


def coverage(daily: DataFrame) -> DataFrame:
    """Mean eligible and funded counts, and mean and minimum funded share."""
    share = F.when(F.col("n_eligible") > 0, F.col("n_funded") / F.col("n_eligible"))
    return daily.agg(
        F.avg("n_eligible").alias("mean_eligible"), F.avg("n_funded").alias("mean_funded"),
        F.avg(share).alias("mean_coverage"), F.min(share).alias("min_coverage"),
    )


def rolling_median(series: DataFrame, window: int = 90, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Trailing median, NULL until half the window is there."""
    w = over(keys, "idx").rowsBetween(-(window - 1), 0)
    value = F.when(F.count("ret").over(w) >= window // 2, F.percentile("ret", F.lit(0.5)).over(w))
    return series.withColumn("rolling_median", value)
