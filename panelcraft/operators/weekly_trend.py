"""Weekly trend portfolio with inverse-volatility weights, a volatility cap and open-to-open fills.

Signals form on Sundays, fills happen at the next day's open and again a week later. Portfolio variance
is taken from the weighted returns of the window itself, so no table of asset pairs is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import CRYPTO_DAYS
from ..functions.windows import over

ONE = "portfolio"


def _day(c: str = "date") -> Column:
    return F.unix_date(F.col(c)).cast("bigint")


def _days(lo: int, hi: int):
    return Window.partitionBy("symbol").orderBy("_day").rangeBetween(lo, hi)


def strict_signals(bars: DataFrame, sma_days: int = 200, vol_days: int = 60, per_year: float = CRYPTO_DAYS) -> DataFrame:
    """Trend and volatility of each symbol and day from windows in which every calendar day is present.

    A missing day, a close not above its average, or no variation makes the symbol inactive.
    """
    rows = bars.withColumn("_day", _day())
    step = over(["symbol"], "_day")
    log_ret = F.when(F.col("_day") - F.lag("_day").over(step) == 1, F.ln(F.col("close") / F.lag("close").over(step)))
    rows = rows.withColumn("log_ret", log_ret)
    sma, vol = _days(-(sma_days - 1), 0), _days(-(vol_days - 1), 0)
    full = (F.count("close").over(sma) == sma_days) & (F.count("close").over(_days(-vol_days, 0)) == vol_days + 1)
    return rows.withColumns({
        "sma": F.when(F.count("close").over(sma) == sma_days, F.avg("close").over(sma)), "_full": full,
        "vol": F.when(F.col("log_ret").isNotNull() & (F.count("log_ret").over(vol) == vol_days), F.stddev_samp("log_ret").over(vol) * per_year**0.5),
    }).withColumn("active", F.coalesce(F.col("_full") & (F.col("close") > F.col("sma")) & (F.col("vol") > 0), F.lit(False))).drop("_full")


def rolling_covariance(returns: DataFrame, pairs: DataFrame | None, window: int, per_year: float = CRYPTO_DAYS) -> DataFrame:
    """Yearly covariance of symbol pairs over a trailing window of common days.

    `pairs` names the pairs wanted (symbol_a, symbol_b); without it, symbols meet on the days they share, so no list of
    pairs is made and pairs that never trade together cost nothing. Returns need (symbol, date, log_ret).
    """
    known = returns.filter("log_ret IS NOT NULL").select("symbol", "date", "log_ret")
    a = known.select(F.col("symbol").alias("symbol_a"), "date", F.col("log_ret").alias("ret_a"))
    b = known.select(F.col("symbol").alias("symbol_b"), "date", F.col("log_ret").alias("ret_b"))
    if pairs is None:
        both = a.join(b, "date").filter("symbol_a < symbol_b")
    else:
        both = pairs.join(a, "symbol_a").join(b, ["symbol_b", "date"])
    w = over(["symbol_a", "symbol_b"], "date").rowsBetween(-(window - 1), 0)
    value = F.when(F.count(F.lit(1)).over(w) == window, F.covar_samp("ret_a", "ret_b").over(w) * per_year)
    return both.withColumn("cov", value).select("symbol_a", "symbol_b", "date", "cov")


def weekly_targets(
    signals: DataFrame, n_symbols: int, vol_days: int = 60, target_vol: float = 0.25, max_notional: float = 1.0, per_year: float = CRYPTO_DAYS
) -> DataFrame:
    """Weights per Sunday and symbol: inverse volatility among active symbols, scaled to the target.

    Only Sundays on which every symbol has a bar count. Rows: (signal_date, symbol, target, est_vol, n_active).
    """
    day = Window.partitionBy("date")
    sundays = signals.filter(F.dayofweek("date") == 1).withColumn("_n", F.count(F.lit(1)).over(day)).filter(F.col("_n") == n_symbols)
    inverse = F.when(F.col("active"), 1.0 / F.nullif(F.col("vol"), F.lit(0.0)))
    base = sundays.withColumn("_inv", inverse).withColumn("_base", F.col("_inv") / F.sum("_inv").over(day))
    weights = base.select(F.col("date").alias("signal_date"), "symbol", "_base", "vol", "active")
    active = weights.filter("active").select("signal_date", "symbol", "_base")
    window = active.withColumn("date", F.explode(F.sequence(F.date_sub("signal_date", vol_days - 1), F.col("signal_date"))))
    daily = window.join(signals.select("symbol", "date", "log_ret"), ["symbol", "date"]).groupBy("signal_date", "date").agg(
        F.sum(F.col("_base") * F.col("log_ret")).alias("_r")
    )
    book = daily.groupBy("signal_date").agg((F.stddev_samp("_r") * per_year**0.5).alias("_vol"))
    out = weights.join(book, "signal_date", "left")
    scale = F.when(F.col("_vol") > 0, F.least(F.lit(max_notional), target_vol / F.nullif(F.col("_vol"), F.lit(0.0)))).otherwise(0.0)
    out = out.withColumn("_scale", scale).withColumn("target", F.coalesce(F.col("_base") * F.col("_scale"), F.lit(0.0)))
    week = Window.partitionBy("signal_date")
    return out.select(
        "signal_date", "symbol", "target", F.coalesce(F.col("_vol") * F.col("_scale"), F.lit(0.0)).alias("est_vol"),
        F.coalesce(F.sum(F.col("_base") * F.col("vol")).over(week) * F.col("_scale"), F.lit(0.0)).alias("corr_one_vol"),
        F.count_if("active").over(week).alias("n_active"),
    )


def with_fills(target_table: DataFrame, bars: DataFrame, n_symbols: int, start: str) -> DataFrame:
    """Targets with open-to-open returns; weeks before the start or without all fills are left out."""
    rows = bars.withColumn("_day", _day())
    opens = rows.withColumns({"fill_open": F.max("open").over(_days(1, 1)), "exit_open": F.max("open").over(_days(8, 8))})
    joined = target_table.join(
        opens.select("symbol", F.col("date").alias("signal_date"), "fill_open", "exit_open"), ["symbol", "signal_date"]
    )
    joined = joined.withColumns({"fill_date": F.date_add("signal_date", 1), "exit_date": F.date_add("signal_date", 8)})
    ready = F.count_if(F.col("fill_open").isNotNull() & F.col("exit_open").isNotNull()).over(Window.partitionBy("signal_date"))
    out = joined.withColumn("_ready", ready).filter((F.col("_ready") == n_symbols) & (F.col("fill_date") >= F.lit(start).cast("date")))
    return out.withColumn("asset_ret", F.col("exit_open") / F.col("fill_open") - 1.0).drop("_ready")


def weekly_results(filled: DataFrame, cost: float) -> DataFrame:
    """Weekly turnover, cost, gross and net return and wealth; the book drifts between scored weeks."""
    holding = F.sum(F.col("target") * F.col("asset_ret")).over(Window.partitionBy("signal_date"))
    rows = filled.withColumn("_hold", holding)
    lost = F.raise_error(F.lit("portfolio lost all capital")).cast("double")
    drifted = F.col("target") * (1.0 + F.col("asset_ret")) / F.when(F.col("_hold") > -1, 1.0 + F.col("_hold")).otherwise(lost)
    rows = rows.withColumn("_after", drifted)
    rows = rows.withColumn("pretrade", F.coalesce(F.lag("_after").over(over(["symbol"], "signal_date")), F.lit(0.0)))
    weeks = rows.groupBy("signal_date", "fill_date", "exit_date").agg(
        F.sum(F.abs(F.col("target") - F.col("pretrade"))).alias("turnover"), F.first("_hold").alias("gross_return"),
        F.sum("target").alias("target_gross"), F.sum("pretrade").alias("pretrade_gross"), F.first("est_vol").alias("est_vol"),
        F.first("corr_one_vol").alias("corr_one_vol"), F.first("n_active").alias("n_active"),
    )
    weeks = weeks.withColumn("cost_fraction", F.col("turnover") * cost)
    weeks = weeks.withColumn("net_return", (1.0 - F.col("cost_fraction")) * (1.0 + F.col("gross_return")) - 1.0).withColumn(ONE, F.lit(1))
    past = over([ONE], "signal_date").rowsBetween(Window.unboundedPreceding, -1)
    weeks = weeks.withColumn("wealth_before", F.coalesce(F.product(1.0 + F.col("net_return")).over(past), F.lit(1.0)))
    return weeks.withColumn("cost_paid", F.col("wealth_before") * F.col("cost_fraction")).drop(ONE)


def daily_marks(filled: DataFrame, weeks: DataFrame, bars: DataFrame, strict: bool = True) -> DataFrame:
    """The equity path: after-cost fill, seven daily closes, exit open, as (date, kind, ord, equity).

    A day on which a symbol has no close raises; if not strict its mark is NULL.
    """
    start = weeks.withColumn("_start", F.col("wealth_before") * (1.0 - F.col("cost_fraction")))
    start = start.withColumn("_cash", F.greatest(F.lit(0.0), 1.0 - F.col("target_gross")))
    fill = start.select("signal_date", F.col("fill_date").alias("date"), F.lit("fill_after_cost").alias("kind"), F.lit(0).alias("ord"), F.col("_start").alias("equity"))
    leave = start.select(
        "signal_date", F.col("exit_date").alias("date"), F.lit("exit_open").alias("kind"), F.lit(2).alias("ord"),
        (F.col("_start") * (1.0 + F.col("gross_return"))).alias("equity"),
    )
    days = filled.select(
        "signal_date", "symbol", "target", "fill_open", F.explode(F.sequence("fill_date", F.date_sub("exit_date", 1))).alias("date")
    ).join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")
    held = days.groupBy("signal_date", "date").agg(
        F.sum(F.col("target") * F.col("close") / F.col("fill_open")).alias("_held"), F.count_if(F.col("close").isNull()).alias("_missing")
    ).join(start.select("signal_date", "_start", "_cash"), "signal_date")
    gone = F.raise_error(F.concat(F.lit("no close on "), F.col("date").cast("string"))) if strict else F.lit(None)
    equity = F.when(F.col("_missing") == 0, F.col("_start") * (F.col("_cash") + F.col("_held"))).otherwise(gone.cast("double"))
    marks = held.select("signal_date", "date", F.lit("daily_close").alias("kind"), F.lit(1).alias("ord"), equity.alias("equity"))
    return fill.unionByName(marks).unionByName(leave)


def missing_closes(filled: DataFrame, bars: DataFrame) -> DataFrame:
    """Days of a holding week on which a symbol of the book has no close: what makes strict daily marks fail."""
    days = filled.select("signal_date", "symbol", F.explode(F.sequence("fill_date", F.date_sub("exit_date", 1))).alias("date"))
    return days.join(bars.filter("close IS NOT NULL").select("symbol", "date"), ["symbol", "date"], "left_anti")


def missing_starts(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols that trade between two days but have no open on the first, and the first day they have one."""
    first = F.lit(start).cast("date")
    inside = bars.filter(F.col("date").between(first, F.lit(end).cast("date")) & F.col("open").isNotNull())
    return inside.groupBy("symbol").agg(F.min("date").alias("first_open")).filter(F.col("first_open") > first)


def buy_and_hold(bars: DataFrame, start: str, end: str, n_symbols: int, strict: bool = True) -> DataFrame:
    """Equal-weight path from the opens of one day to the opens of another, marked at daily closes.

    A symbol without a close on a day is left out of that day's value; `n_marked` tells how many were in. Fewer than
    `n_symbols` opens on the first day raise; if not strict, the symbols without one are held as nothing.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    base = bars.filter((F.col("date") == first) & F.col("open").isNotNull()).select("symbol", F.col("open").alias("_base"))
    window = bars.filter(F.col("date").between(first, last)).join(base, "symbol")
    price = F.when(F.col("date") == last, F.col("open")).otherwise(F.col("close"))
    out = window.groupBy("date").agg(
        F.sum(price / F.col("_base") / n_symbols).alias("equity"), F.count(F.lit(1)).alias("n_marked")
    )
    if strict:
        opened = base.agg(F.count(F.lit(1))).scalar()
        fault = F.raise_error(F.lit(f"fewer than {n_symbols} opens on {start}")).cast("double")
        out = out.withColumn("equity", F.when(opened == n_symbols, F.col("equity")).otherwise(fault))
    return out
