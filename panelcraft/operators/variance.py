"""Realised variance, implied-minus-realised premium, and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import CRYPTO_DAYS, regime
from ..functions.windows import over, rolling


def realized_variance(closes: DataFrame, window: int, keys: Sequence[str] = ("symbol",), days: float = CRYPTO_DAYS) -> DataFrame:
    """Trailing yearly variance over full windows, and the same re-anchored to look forward."""
    if window < 2:
        raise ValueError("window must be at least 2")
    w = over(keys, "date")
    squared = F.pow(F.ln(F.col("close") / F.lag("close").over(w)), F.lit(2.0))
    out = closes.withColumn("_sq", squared)
    out = out.withColumn("rv_trailing", rolling("_sq", "sum", keys, "date", window) * (days / window))
    return out.withColumn("rv_forward", F.lead("rv_trailing", window).over(w)).drop("_sq")


def variance_premium(implied: DataFrame, realized: DataFrame, boundary: str | None = None) -> DataFrame:
    """Implied variance against trailing and forward realised variance, by date."""
    joined = implied.withColumn("implied_var", F.pow(F.col("dvol_close") / 100.0, F.lit(2.0))).join(realized, "date")
    label = regime(F.col("date"), boundary) if boundary else regime(F.col("date"))
    return (
        joined.withColumn("vrp_forward", F.col("implied_var") - F.col("rv_forward"))
        .withColumn("vrp_trailing", F.col("implied_var") - F.col("rv_trailing"))
        .withColumn("vol_spread_forward", F.col("dvol_close") / 100.0 - F.sqrt("rv_forward"))
        .withColumn("regime", label)
    )


def regime_stats(premium: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per regime: observations, mean premium, share positive, mean implied and realised volatility."""
    rows = premium.filter("vrp_forward IS NOT NULL")
    return rows.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("vrp_forward").alias("mean_vrp"),
        F.avg((F.col("vrp_forward") > 0).cast("double")).alias("frac_positive"),
        F.avg("dvol_close").alias("mean_implied_vol_pct"), F.avg(100.0 * F.sqrt("rv_forward")).alias("mean_realized_vol_pct"),
    )


def alignment_funnel(implied: DataFrame, closes: DataFrame, premium: DataFrame) -> DataFrame:
    """Input days of both sides, aligned rows and rows with a forward value, one row per measure."""
    def one(df: DataFrame, name: str, n) -> DataFrame:
        return df.agg(n.alias("n")).select(F.lit(name).alias("measure"), "n")

    return (
        one(implied, "implied_days", F.count_distinct("date"))
        .unionByName(one(closes, "price_days", F.count_distinct("date")))
        .unionByName(one(premium, "aligned_rows", F.count(F.lit(1))))
        .unionByName(one(premium, "forward_rows", F.count("vrp_forward")))
    )


def strided_means(series: DataFrame, window: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Means of the non-overlapping strided phases: the median phase, the range, and phase zero's size."""
    phase = F.pmod("idx", F.lit(window))
    means = series.groupBy(*keys, phase.alias("phase")).agg(F.avg("ret").alias("_mean"), F.count("ret").alias("_n")).filter("_n >= 2")
    return means.groupBy(*keys).agg(
        F.median("_mean").alias("phase_median"), F.min("_mean").alias("phase_min"), F.max("_mean").alias("phase_max"),
        F.max(F.when(F.col("phase") == 0, F.col("_n"))).alias("n_strided"),
    )
