"""Monthly long-or-cash portfolios, always-invested and market twins, bond returns, decompositions.

A held month depends on the past only through the wealth it opens with, and the drifted weights at its
end depend on that month alone. So the day-by-day simulation becomes growth within months, a `lag`
between month ends and one running product over months; all variants run in the same job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import EQUITY_DAYS, month_start
from ..functions.windows import over, running, with_grid

COUPONS = 20
COUPONS_PER_YEAR = 2


def bond_returns(yields: DataFrame, keys: Sequence[str] = (), value: str = "bond_yield", per_year: float = EQUITY_DAYS) -> DataFrame:
    """Daily return of a constant-maturity ten-year par bond: carry, duration and convexity at
    yesterday's yield, by exact sums over its coupons. The first day has none."""
    if not keys:
        yields, keys = yields.withColumn("_one", F.lit(1)), ["_one"]
    before = F.lag(value).over(over(keys, "date"))
    y = F.when(F.col(value) > 0, F.col(value)).otherwise(F.raise_error(F.lit("par yield must be positive")).cast("double"))
    rows = yields.withColumn("_now", y).withColumn("_before", before).filter("_before IS NOT NULL")
    i = F.col("_before") / COUPONS_PER_YEAR

    def total(term) -> Column:
        def flow(t: Column) -> Column:
            return i + F.when(t == COUPONS, 1.0).otherwise(0.0)

        return F.aggregate(F.sequence(F.lit(1), F.lit(COUPONS)), F.lit(0.0), lambda a, t: a + term(t, flow(t)))

    price = total(lambda t, c: c * F.pow(1.0 + i, -t.cast("double")))
    macaulay = total(lambda t, c: t * c * F.pow(1.0 + i, -t.cast("double")))
    bend = total(lambda t, c: t * (t + 1) * c * F.pow(1.0 + i, -(t + 2).cast("double")))
    move = F.col("_now") - F.col("_before")
    duration = F.col("_mac") / F.col("_price") / (1.0 + i) / COUPONS_PER_YEAR
    convexity = F.col("_bend") / F.col("_price") / COUPONS_PER_YEAR**2
    out = rows.withColumns({"_price": price, "_mac": macaulay, "_bend": bend})
    out = out.withColumns({"duration": duration, "convexity": convexity})
    ret = F.col("_before") / per_year - F.col("duration") * move + 0.5 * F.col("convexity") * move * move
    return out.withColumn("bond_ret", ret).drop("_now", "_before", "_price", "_mac", "_bend", "_one")


def complete_dates(assets: DataFrame) -> DataFrame:
    """Rows of the dates on which every asset has a return, with the ordinal of their month."""
    n = assets.select("asset").distinct().agg(F.count(F.lit(1))).scalar()
    full = assets.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select("date")
    kept = assets.join(full, "date", "left_semi").withColumn("month", month_start("date"))
    return kept.withColumn("month_no", F.dense_rank().over(over(["asset"], "month")) - 1)


def month_signals(assets: DataFrame, sma_months: Sequence[int]) -> DataFrame:
    """Per asset, month and moving-average length: month-end level, average, strength and activity.

    Levels are products of returns, so ties with the average are exact; a tie is inactive.
    """
    level = F.product(1.0 + F.col("ret")).over(running(["asset"], "date"))
    ends = assets.withColumn("_level", level).groupBy("asset", "month_no").agg(
        F.max_by("_level", "date").alias("level"), F.max("date").alias("month_end")
    )
    w = over(["asset"], "month_no")
    averages = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.when(F.count("level").over(w.rowsBetween(-(k - 1), 0)) == k, F.avg("level").over(w.rowsBetween(-(k - 1), 0))).alias("sma"),
        )
        for k in sorted(set(sma_months))
    ])
    rows = ends.withColumn("_all", averages).withColumn("_a", F.explode("_all")).filter("_a.sma IS NOT NULL")
    strength = F.when(F.col("sma") > 0, F.col("level") / F.col("sma") - 1.0).otherwise(-1.0)
    return rows.select(
        "asset", "month_no", "month_end", "level", F.col("_a.k").alias("sma_months"), F.col("_a.sma").alias("sma")
    ).withColumn("strength", strength).withColumn("active", F.col("level") > F.col("sma"))


def variant(name: str, sma_months: int = 10, top_k: int = 0, always: bool = False, only: str = "", cost: float = 0.0005) -> dict[str, object]:
    """One portfolio rule: all active assets at 1/N, the k strongest at 1/k, always invested, or one asset alone."""
    return {"variant": name, "sma_months": sma_months, "top_k": top_k, "always": always, "only": only, "cost": cost}


def targets(signals: DataFrame, variants: Sequence[Mapping[str, object]]) -> DataFrame:
    """Target weight per variant, held month and asset, from the signals of the month before."""
    grid = [{**v, "_k": v["sma_months"]} for v in variants]
    rows = with_grid(signals, [{k: v for k, v in g.items() if k != "sma_months"} for g in grid])
    rows = rows.filter((F.col("sma_months") == F.col("_k")) & ((F.col("only") == "") | (F.col("only") == F.col("asset"))))
    month = Window.partitionBy("variant", "month_no")
    strongest = Window.partitionBy("variant", "month_no", "active").orderBy(F.desc("strength"), "asset")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(month), "_rank": F.row_number().over(strongest)})
    weight = (
        F.when(F.col("always"), 1.0 / F.col("_n"))
        .when(~F.col("active"), 0.0)
        .when(F.col("top_k") <= 0, 1.0 / F.col("_n"))
        .when(F.col("_rank") <= F.col("top_k"), 1.0 / F.nullif(F.col("top_k"), F.lit(0)))
        .otherwise(0.0)
    )
    return rows.select(
        "variant", "cost", (F.col("month_no") + 1).alias("month_no"), "asset", weight.alias("target"), F.col("month_end").alias("signal_date"), "active"
    )


def position_log(target_table: DataFrame) -> DataFrame:
    """Per variant and signal date which assets are held."""
    return target_table.groupBy("variant", "signal_date").agg(
        F.count_if(F.col("target") > 0).alias("n_active"),
        F.array_sort(F.collect_list(F.when(F.col("target") > 0, F.col("asset")))).alias("held"),
    )


def simulate(assets: DataFrame, cash: DataFrame, target_table: DataFrame, expense: Column | float) -> DataFrame:
    """Daily results of every variant.

    `assets` are complete dates with months, `cash` gives `cash_ret` by date, `expense` is the daily
    expense share of a holding (it may depend on `asset`). Rows carry net and market-only return,
    excess over cash, invested share at the close, wealth, the day's cost, and the month's turnover on
    its first day.
    """
    expense = expense if isinstance(expense, Column) else F.lit(expense)
    grown = (1.0 + F.col("ret")) * (1.0 - F.col("_e"))
    inside = running(["asset", "month_no"], "date")
    days = assets.withColumn("_e", expense).withColumn("growth", F.product(grown).over(inside))
    days = days.withColumn("_open", F.coalesce(F.lag("growth").over(over(["asset", "month_no"], "date")), F.lit(1.0)))
    calendar = assets.select("date", "month", "month_no").distinct().join(cash.select("date", "cash_ret"), "date")
    calendar = calendar.withColumn("cash_growth", F.product(1.0 + F.col("cash_ret")).over(running(["month_no"], "date")))

    held = target_table.select("variant", "cost", "month_no", "asset", "target").join(
        days.select("date", "month_no", "asset", "ret", "growth", "_open", "_e"), ["month_no", "asset"]
    )
    value = F.col("target") * F.col("growth")
    daily = held.groupBy("variant", "cost", "month_no", "date").agg(
        F.sum(value).alias("_held"), F.sum("target").alias("invested_target"),
        F.sum(F.col("target") * F.col("_open")).alias("_held_open"), F.sum(F.col("target") * F.col("_open") * F.col("ret")).alias("_gain"),
        F.sum(value * F.col("_e") / (1.0 - F.col("_e"))).alias("_expense"),
    ).join(calendar, ["date", "month_no"])
    daily = daily.withColumn("_cash", (1.0 - F.col("invested_target")) * F.col("cash_growth"))
    daily = daily.withColumn("_value", F.col("_held") + F.col("_cash"))

    ends = daily.groupBy("variant", "cost", "month_no").agg(
        F.max_by("_value", "date").alias("_end"), F.first("invested_target").alias("_invested")
    )
    last = days.groupBy("asset", "month_no").agg(F.max_by("growth", "date").alias("_growth"))
    weights = (
        target_table.select("variant", "cost", "month_no", "asset", "target").join(last, ["month_no", "asset"])
        .join(ends, ["variant", "cost", "month_no"])
        .withColumn("_drifted", F.col("target") * F.col("_growth") / F.col("_end"))
        .withColumn("_before", F.coalesce(F.lag("_drifted").over(over(["variant", "cost", "asset"], "month_no")), F.lit(0.0)))
    )
    months = weights.groupBy("variant", "cost", "month_no").agg(
        F.sum(F.abs(F.col("target") - F.col("_before"))).alias("turnover"), F.first("_end").alias("_end")
    )
    kept = 1.0 - F.col("cost") * F.col("turnover")
    wiped = F.raise_error(F.lit("a rebalance costs all capital")).cast("double")
    months = months.withColumn("_kept", F.when(kept > 0, kept).otherwise(wiped))
    past = over(["variant", "cost"], "month_no").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_wealth", F.coalesce(F.product(F.col("_kept") * F.col("_end")).over(past), F.lit(1.0))).drop("_end")

    out = daily.join(months, ["variant", "cost", "month_no"])
    w = over(["variant", "cost", "month_no"], "date")
    first = F.row_number().over(w) == 1
    before = F.coalesce(F.lag("_value").over(w), F.lit(1.0))
    cash_before = F.coalesce(F.lag("_cash").over(w), 1.0 - F.col("invested_target"))
    out = out.withColumns({"_first": first, "_previous": before, "_cash_open": cash_before})
    opened = F.col("_wealth") * F.col("_kept")
    return out.select(
        "variant", "date", "month_no", "cash_ret",
        (F.when(F.col("_first"), F.col("_kept")).otherwise(1.0) * F.col("_value") / F.col("_previous") - 1.0).alias("net_ret"),
        ((F.col("_gain") + F.col("_cash_open") * F.col("cash_ret")) / F.col("_previous")).alias("gross_ret"),
        (F.col("_held") / F.col("_value")).alias("invested"), F.col("invested_target"),
        (opened * F.col("_value")).alias("wealth"),
        (opened * F.col("_expense") + F.when(F.col("_first"), F.col("_wealth") * F.col("cost") * F.col("turnover")).otherwise(0.0)).alias("cost_paid"),
        F.when(F.col("_first"), F.col("turnover")).alias("turnover"),
    ).withColumn("excess_ret", F.col("net_ret") - F.col("cash_ret"))


def as_series(daily: DataFrame, value: str, key: str = "variant") -> DataFrame:
    """A daily result column as (series_id, idx, dt, ret)."""
    idx = F.row_number().over(over([key], "date")) - 1
    return daily.select(F.col(key).alias("series_id"), idx.alias("idx"), F.col("date").alias("dt"), F.col(value).alias("ret"))


def summary(daily: DataFrame) -> DataFrame:
    """Per variant: compounded gross and net gain, cost paid, time in market, mean turnover, largest target."""
    return daily.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_days"), (F.product(1.0 + F.col("gross_ret")) - 1.0).alias("gross_gain"),
        (F.product(1.0 + F.col("net_ret")) - 1.0).alias("net_gain"), F.sum("cost_paid").alias("cost_paid"),
        F.avg((F.col("invested_target") > 0).cast("double")).alias("time_in_market"), F.avg("turnover").alias("mean_turnover"),
        F.max("invested_target").alias("max_invested"),
    )


def timing_parts(daily: DataFrame, strategy: str, always: str, market: DataFrame, expense: float) -> DataFrame:
    """Daily timing (strategy minus always invested), tilt (always invested minus market) and their sum."""
    def pick(name: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col("net_ret")))

    both = daily.filter(F.col("variant").isin(strategy, always)).groupBy("date").agg(
        pick(strategy).alias("_s"), pick(always).alias("_a")
    ).join(market.select("date", (F.col("market_ret") - expense).alias("_m")), "date")
    return both.select(
        "date", (F.col("_s") - F.col("_a")).alias("timing"), (F.col("_a") - F.col("_m")).alias("tilt"), (F.col("_s") - F.col("_m")).alias("deploy")
    )


def annual_parts(parts: DataFrame, columns: Sequence[str], per_year: float = EQUITY_DAYS) -> DataFrame:
    """Yearly mean of each daily component."""
    return parts.agg(*[(F.avg(c) * per_year).alias(c) for c in columns])
