"""Volatility-managed exposure of return series: variance estimates, weights, costs, decomposition.

Input is (series_id, date, excess, cash_ret). Variants differ in estimator, cap and costs and are rows
of a literal grid, so every series and variant is computed together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import EQUITY_DAYS, month_start
from ..functions.ema import Ema, with_ema
from ..functions.windows import over, with_grid

# Smoothing of the exponential estimator and its monthly scale.
EWMA_KEEP, EWMA_DAYS = 0.94, 21.0


def spec(
    name: str, estimator: str = "rv1", cap: float = 2.0, expense: float = 0.0010, financing: float = 0.010,
    turnover_cost: float = 0.0005, expanding: bool = False, burn_in: int = 60,
) -> dict[str, object]:
    """One variant: `rvK` uses the K months before, `ewma` the exponential variance at the last month end."""
    return {
        "variant": name, "estimator": estimator, "cap": float(cap), "expense": float(expense), "financing": float(financing),
        "turnover_cost": float(turnover_cost), "expanding": expanding, "burn_in": burn_in,
    }


def with_months(daily: DataFrame) -> DataFrame:
    rows = daily.withColumn("month", month_start("date"))
    return rows.withColumn("month_no", F.dense_rank().over(over(["series_id"], "month")) - 1)


def prior_variance(daily: DataFrame, estimators: Sequence[str]) -> DataFrame:
    """Variance known before each month, per series, month and estimator."""
    squares = with_months(daily).withColumn("_sq", F.col("excess") * F.col("excess"))
    rows = with_ema(squares, {"_ewma": Ema("_sq", 1.0 - EWMA_KEEP)}, ["series_id"], "date") if "ewma" in estimators else squares.withColumn("_ewma", F.lit(0.0))
    months = rows.groupBy("series_id", "month_no").agg(F.sum("_sq").alias("_sum"), F.max_by("_ewma", "date").alias("_last"))
    w = over(["series_id"], "month_no")
    choices = []
    for name in sorted(set(estimators)):
        if name == "ewma":
            value = F.lag("_last").over(w) * EWMA_DAYS
        else:
            k = int(name.removeprefix("rv"))
            frame = w.rowsBetween(-k, -1)
            value = F.when(F.count("_sum").over(frame) == k, F.sum("_sum").over(frame))
        choices.append(F.struct(F.lit(name).alias("estimator"), value.alias("variance")))
    spread = months.withColumn("_all", F.array(*choices)).withColumn("_c", F.explode("_all"))
    return spread.select("series_id", "month_no", "_c.estimator", "_c.variance").filter("variance > 0")


def managed_series(daily: DataFrame, specs: Sequence[Mapping[str, object]], per_year: float = EQUITY_DAYS) -> DataFrame:
    """Managed, unmanaged and difference series per variant, with weights and the day's costs.

    The scale matches the uncapped managed deviation to the unmanaged one, over the whole sample or over
    the months before (weight one during the burn-in). Turnover is charged on a month's first day.
    """
    variance = prior_variance(daily, [str(s["estimator"]) for s in specs])
    rows = with_months(daily).join(variance, ["series_id", "month_no"]).withColumn("_raw", F.col("excess") / F.col("variance"))
    keys = ["series_id", "estimator"]
    whole = Window.partitionBy(*keys)
    past = Window.partitionBy(*keys).orderBy("month_no").rangeBetween(Window.unboundedPreceding, -1)

    def scale(w) -> Column:
        return F.stddev_pop("excess").over(w) / F.nullif(F.stddev_pop("_raw").over(w), F.lit(0.0))

    rows = rows.withColumns({
        "_full": scale(whole), "_grow": scale(past), "_seen": F.count(F.lit(1)).over(past), "_start": F.min("month_no").over(whole),
    })
    grid = [{("_e" if k == "estimator" else k): v for k, v in s.items()} for s in specs]
    rows = with_grid(rows, grid).filter("estimator = _e")
    warm = (F.col("month_no") - F.col("_start") < F.col("burn_in")) | (F.col("_seen") < 2)
    c = F.when(F.col("expanding"), F.col("_grow")).otherwise(F.col("_full"))
    weight = F.when(F.col("expanding") & warm, 1.0).otherwise(F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("cap"), c / F.col("variance")))))
    w = over(["series_id", "variant"], "date")
    rows = rows.withColumn("weight", weight)
    new_month = F.coalesce(F.lag("month_no").over(w) != F.col("month_no"), F.lit(True))
    turnover = F.when(new_month, F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(1.0))))
    rows = rows.withColumn("turnover", turnover).withColumns({
        "turnover_paid": F.coalesce("turnover", F.lit(0.0)) * F.col("turnover_cost"),
        "financing_paid": F.col("financing") / per_year * F.greatest(F.col("weight") - 1.0, F.lit(0.0)),
        "expense_paid": F.col("expense") / per_year * F.col("weight"),
    })
    managed = F.col("weight") * F.col("excess") - F.col("financing_paid") - F.col("expense_paid") - F.col("turnover_paid")
    rows = rows.withColumn("managed", managed).withColumn("unmanaged", F.col("excess") - F.col("expense") / per_year)
    return rows.select(
        "series_id", "variant", "date", "month_no", "weight", "cap", F.col("_full").alias("scale"), "turnover", "turnover_paid",
        "financing_paid", "expense_paid", "managed", "unmanaged", (F.col("managed") - F.col("unmanaged")).alias("difference"),
        (F.col("managed") + F.col("cash_ret")).alias("managed_total"), (F.col("unmanaged") + F.col("cash_ret")).alias("unmanaged_total"),
    )


def exposure_summary(managed: DataFrame) -> DataFrame:
    """Per series and variant: scale, mean and largest weight, shares capped and levered, costs."""
    return managed.groupBy("series_id", "variant").agg(
        F.count(F.lit(1)).alias("n_days"), F.first("scale").alias("scale"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"),
        F.avg((F.col("weight") >= F.col("cap") - 1e-12).cast("double")).alias("frac_capped"),
        F.avg((F.col("weight") > 1.0 + 1e-12).cast("double")).alias("frac_levered"), F.avg("turnover").alias("mean_turnover"),
        F.sum("financing_paid").alias("financing_cost"), F.sum("turnover_paid").alias("turnover_cost"), F.sum("expense_paid").alias("expense_cost"),
    )


def costless(name: str, cap: float, base: Mapping[str, object]) -> dict[str, object]:
    return {**base, "variant": name, "cap": float(cap), "expense": 0.0, "financing": 0.0, "turnover_cost": 0.0}


def gross_decomposition(managed: DataFrame, per_year: float = EQUITY_DAYS) -> DataFrame:
    """Yearly difference without cap and cost, with the cap, and net, from variants `uncapped`, `capped`, `net`."""
    def pick(name: str) -> Column:
        return F.avg(F.when(F.col("variant") == name, F.col("difference"))) * per_year

    agg = managed.groupBy("series_id").agg(pick("uncapped").alias("uncapped"), pick("capped").alias("capped"), pick("net").alias("net"))
    return agg.withColumn("cap_drag", F.col("capped") - F.col("uncapped")).withColumn("cost_drag", F.col("net") - F.col("capped"))


def as_series(managed: DataFrame, value: str = "difference") -> DataFrame:
    """A column as series named `series_id/variant`."""
    idx = F.row_number().over(over(["series_id", "variant"], "date")) - 1
    return managed.select(F.concat_ws("/", "series_id", "variant").alias("series_id"), idx.alias("idx"), F.col("date").alias("dt"), F.col(value).alias("ret"))


def asymmetry(scores: DataFrame, market: str, bar: float = 0.95, enough: int = 4) -> DataFrame:
    """Does the market pass while most of the other series fail? Scores need `series_id` and `psr0`."""
    passes = F.coalesce(F.col("psr0") >= bar, F.lit(False))
    is_market = F.col("series_id") == market
    agg = scores.agg(
        F.bool_or(is_market & passes).alias("market_passes"), F.count_if(~is_market & ~passes).alias("n_failing"),
        F.count_if(~is_market).alias("n_factors"), F.max_by("series_id", F.when(~is_market, F.col("psr0"))).alias("best"),
    )
    finding = (
        F.when(~F.col("market_passes") & (F.col("n_failing") == F.col("n_factors")), "uniform_null")
        .when(~F.col("market_passes"), "market_fails").when(F.col("n_failing") >= enough, "confirmed").otherwise("partial")
    )
    return agg.withColumn("asymmetry_confirmed", F.col("market_passes") & (F.col("n_failing") >= enough)).withColumn("finding", finding)
