"""Long-or-cash, volatility-managed, tilt and weekly-trend portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import EQUITY_DAYS
from ..functions.windows import over, with_grid
from ..operators import crossval as CV
from ..operators import portfolio as PF
from ..operators import regression as RG
from ..operators import returns as R
from ..operators import scoring as S
from ..operators import volmanaged as VM
from ..operators import weekly_trend as WT
from .inputs import asset_ret, bars, bars_strict, factors, macro_panel, rate_curve, round_to, tilt_base, tilt_panel
from .registry import cte, query
from .sqltext import max_sharpe, psr_of, score_ctes
from .stage import stage

# ---- month-end signals ----------------------------------------------------------------------------

cte("month_days", """
SELECT asset, date, ret, dense_rank() OVER (PARTITION BY asset ORDER BY date_trunc('month', date)) - 1 AS month_no
FROM asset_ret WHERE date IN (SELECT date FROM asset_ret GROUP BY 1 HAVING count(*) = 6)""")
cte("month_levels", """
SELECT asset, month_no, arg_max(level, date) AS level, max(date) AS month_end FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY asset ORDER BY date) AS level FROM month_days) GROUP BY 1, 2""")


def _sma(source: str, lengths) -> str:
    return " UNION ALL ".join(
        f"SELECT *, {k} AS k, CASE WHEN count(*) OVER w = {k} THEN avg(level) OVER w END AS sma FROM {source} "
        f"WINDOW w AS (PARTITION BY asset ORDER BY month_no ROWS {k - 1} PRECEDING)" for k in lengths
    )


cte("month_trend", f"SELECT *, level / sma - 1 AS strength, level > sma AS active FROM ({_sma('month_levels', (6, 8, 10, 12))}) WHERE sma IS NOT NULL")


def month_days(spark, sf):
    return PF.complete_dates(stage(asset_ret(spark, sf), "assets"))


@query("win13_month_signal", "SELECT asset, month_no, month_end, k AS sma_months, round(level, 8) AS level, round(sma, 8) AS sma, active FROM month_trend")
def win13(spark, sf):
    return round_to(PF.month_signals(month_days(spark, sf), (6, 8, 10, 12)).drop("strength"), 8, "level", "sma")


@query("win14_trend_strength", "SELECT asset, month_no, round(strength, 8) AS strength FROM month_trend WHERE k = 10")
def win14(spark, sf):
    out = PF.month_signals(month_days(spark, sf), (10,)).select("asset", "month_no", "strength")
    return round_to(out, 8, "strength")


SECTORS = [
    PF.variant("ma10"), PF.variant("ma6", 6), PF.variant("ma8", 8), PF.variant("ma12", 12), PF.variant("top3", top_k=3),
    PF.variant("always", always=True), PF.variant("cost10", cost=0.0010), PF.variant("cost20", cost=0.0020),
]
CROSS = [
    PF.variant("all"), PF.variant("sma6", 6), PF.variant("sma8", 8), PF.variant("sma12", 12),
    PF.variant("equity_alone", only="equity"), PF.variant("bond_alone", only="bond"),
]
SECTOR_EXPENSE = 0.0010 / EQUITY_DAYS
CROSS_EXPENSE = {"equity": 0.0010, "bond": 0.0015}


def _values(variants) -> str:
    rows = ", ".join(
        f"('{v['variant']}', {v['sma_months']}, {v['top_k']}, {v['always']}, '{v['only']}', {v['cost']!r}::DOUBLE)" for v in variants
    )
    return f"(VALUES {rows}) v(variant, k, top_k, always, only_asset, cost)"


def sim_ctes(p: str, days: str, trend: str, cash: str, variants, expense: str) -> None:
    """Declare the month-segment simulation `<p>_daily` of a set of variants."""
    cte(f"{p}_target", f"""
SELECT variant, cost, month_no + 1 AS month_no, asset, month_end AS signal_date,
  CASE WHEN always THEN 1.0 / n WHEN NOT active THEN 0 WHEN top_k <= 0 THEN 1.0 / n WHEN rk <= top_k THEN 1.0 / top_k ELSE 0 END AS target
FROM (SELECT *, count(*) OVER (PARTITION BY variant, month_no) AS n,
        row_number() OVER (PARTITION BY variant, month_no, active ORDER BY strength DESC, asset) AS rk
      FROM {trend} t, {_values(variants)} WHERE t.k = v.k AND only_asset IN ('', asset))""")
    cte(f"{p}_growth", f"""
SELECT *, coalesce(lag(g) OVER (PARTITION BY asset, month_no ORDER BY date), 1.0) AS g0 FROM (
  SELECT *, product((1 + ret) * (1 - e)) OVER (PARTITION BY asset, month_no ORDER BY date) AS g FROM (SELECT *, {expense} AS e FROM {days}))""")
    cte(f"{p}_cash", f"""
SELECT date, month_no, cash_ret, product(1 + cash_ret) OVER (PARTITION BY month_no ORDER BY date) AS gc
FROM (SELECT DISTINCT date, month_no FROM {days}) JOIN {cash} USING (date)""")
    cte(f"{p}_value", f"""
SELECT *, held + (1 - inv) * gc AS val FROM (
  SELECT variant, cost, t.month_no, date, sum(target * g) AS held, sum(target) AS inv, sum(target * g0 * ret) AS gain, sum(target * g * e / (1 - e)) AS exp_paid
  FROM {p}_target t JOIN {p}_growth d ON t.month_no = d.month_no AND t.asset = d.asset GROUP BY ALL) JOIN {p}_cash USING (date, month_no)""")
    cte(f"{p}_month", f"""
SELECT variant, month_no, any_value(p_end) AS p_end, sum(abs(target - coalesce(w0, 0))) AS turnover, any_value(cost) AS cost FROM (
  SELECT *, lag(target * g_end / p_end) OVER (PARTITION BY variant, asset ORDER BY month_no) AS w0
  FROM {p}_target JOIN (SELECT asset, month_no, arg_max(g, date) AS g_end FROM {p}_growth GROUP BY 1, 2) USING (asset, month_no)
  JOIN (SELECT variant, month_no, arg_max(val, date) AS p_end FROM {p}_value GROUP BY 1, 2) USING (variant, month_no)) GROUP BY 1, 2""")
    cte(f"{p}_daily", f"""
SELECT variant, date, month_no, cash_ret, CASE WHEN rn = 1 THEN 1 - cost * turnover ELSE 1 END * val / prev - 1 AS net_ret, (gain + cash0 * cash_ret) / prev AS gross_ret,
       held / val AS invested, inv AS invested_target, w0 * (1 - cost * turnover) * val AS wealth,
       w0 * (1 - cost * turnover) * exp_paid + CASE WHEN rn = 1 THEN w0 * cost * turnover ELSE 0 END AS cost_paid, CASE WHEN rn = 1 THEN turnover END AS turnover,
       CASE WHEN rn = 1 THEN 1 - cost * turnover ELSE 1 END * val / prev - 1 - cash_ret AS excess_ret
FROM (SELECT d.*, m.turnover, m.w0, row_number() OVER w AS rn, coalesce(lag(val) OVER w, 1.0) AS prev, coalesce(lag((1 - inv) * gc) OVER w, 1 - inv) AS cash0
      FROM {p}_value d JOIN (SELECT *, coalesce(product((1 - cost * turnover) * p_end) OVER (PARTITION BY variant ORDER BY month_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS w0 FROM {p}_month) m
      USING (variant, month_no) WINDOW w AS (PARTITION BY variant, month_no ORDER BY date))""")


sim_ctes("sector", "month_days", "month_trend", "macro_panel", SECTORS, f"({SECTOR_EXPENSE!r}::DOUBLE)")
_DAILY = ("net_ret", "gross_ret", "invested", "wealth", "cost_paid", "turnover", "excess_ret")
_DAILY_SQL = "variant, date, month_no, " + ", ".join(f"round({c}, 8) AS {c}" for c in _DAILY)


def sector_daily(spark, sf):
    days = stage(month_days(spark, sf), "assets")
    signals = PF.month_signals(days, [v["sma_months"] for v in SECTORS])
    targets = stage(PF.targets(signals, SECTORS), "targets")
    cash = stage(macro_panel(spark, sf).select("date", "cash_ret"), "cash")
    return PF.simulate(days, cash, targets, SECTOR_EXPENSE)


@query("top01_strongest_assets", "SELECT variant, month_no, asset, round(target, 8) AS target FROM sector_target")
def top01(spark, sf):
    signals = PF.month_signals(month_days(spark, sf), [v["sma_months"] for v in SECTORS])
    return round_to(PF.targets(signals, SECTORS).select("variant", "month_no", "asset", "target"), 8, "target")


@query("pnl12_sector_rotation", f"SELECT {_DAILY_SQL} FROM sector_daily")
def pnl12(spark, sf):
    return round_to(sector_daily(spark, sf).select("variant", "date", "month_no", *_DAILY), 8, *_DAILY)


cte("market", "SELECT date, avg(ret) AS market_ret FROM asset_ret GROUP BY 1")
cte("timing_parts", f"""
SELECT date, s - a AS timing, a - (market_ret - {SECTOR_EXPENSE!r}) AS tilt, s - (market_ret - {SECTOR_EXPENSE!r}) AS deploy FROM (
  SELECT date, max(net_ret) FILTER (variant = 'ma10') AS s, max(net_ret) FILTER (variant = 'always') AS a FROM sector_daily WHERE variant IN ('ma10', 'always') GROUP BY 1) JOIN market USING (date)""")


def timing_parts(spark, sf):
    market = asset_ret(spark, sf).groupBy("date").agg(F.avg("ret").alias("market_ret"))
    return PF.timing_parts(sector_daily(spark, sf), "ma10", "always", market, SECTOR_EXPENSE)


@query("pnl12_timing_parts", "SELECT date, round(timing, 8) AS timing, round(tilt, 8) AS tilt, round(deploy, 8) AS deploy FROM timing_parts")
def pnl12_parts(spark, sf):
    return round_to(timing_parts(spark, sf), 8, "timing", "tilt", "deploy")


@query("scr29_return_decomposition", "SELECT round(avg(timing) * 252, 8) AS timing, round(avg(tilt) * 252, 8) AS tilt, round(avg(deploy) * 252, 8) AS deploy FROM timing_parts")
def scr29(spark, sf):
    return round_to(PF.annual_parts(timing_parts(spark, sf), ["timing", "tilt", "deploy"]), 8, "timing", "tilt", "deploy")


# ---- equity and bond sleeves ----------------------------------------------------------------------

_COUPON = "SELECT date, y, y0, {} FROM (SELECT date, bond_yield AS y, lag(bond_yield) OVER (ORDER BY date) AS y0 FROM macro_panel), (SELECT unnest(range(1, 21)) AS t) WHERE y0 IS NOT NULL GROUP BY ALL"
cte("bond", "SELECT *, y0 / 252.0 - duration * (y - y0) + 0.5 * convexity * (y - y0) * (y - y0) AS bond_ret FROM (SELECT date, y, y0, mac / price / (1 + y0 / 2) / 2 AS duration, bend / price / 4 AS convexity FROM (" + _COUPON.format(
    "sum((y0 / 2 + (t = 20)::INT) * power(1 + y0 / 2, -t)) AS price, sum(t * (y0 / 2 + (t = 20)::INT) * power(1 + y0 / 2, -t)) AS mac, "
    "sum(t * (t + 1) * (y0 / 2 + (t = 20)::INT) * power(1 + y0 / 2, -(t + 2))) AS bend") + "))")


@query("pnl21_bond_returns", "SELECT date, round(duration, 7) AS duration, round(convexity, 6) AS convexity, round(bond_ret, 8) AS bond_ret FROM bond")
def pnl21(spark, sf):
    out = PF.bond_returns(macro_panel(spark, sf)).select("date", "duration", "convexity", "bond_ret")
    return round_to(round_to(round_to(out, 7, "duration"), 6, "convexity"), 8, "bond_ret")


cte("sleeves", """
SELECT asset, date, ret, dense_rank() OVER (PARTITION BY asset ORDER BY date_trunc('month', date)) - 1 AS month_no FROM (
  SELECT 'equity' AS asset, date, equity_ret AS ret FROM macro_panel JOIN bond USING (date) UNION ALL SELECT 'bond', date, bond_ret FROM bond)""")
cte("sleeve_levels", "SELECT asset, month_no, arg_max(level, date) AS level, max(date) AS month_end FROM (SELECT *, product(1 + ret) OVER (PARTITION BY asset ORDER BY date) AS level FROM sleeves) GROUP BY 1, 2")
cte("sleeve_trend", f"SELECT *, level / sma - 1 AS strength, level > sma AS active FROM ({_sma('sleeve_levels', (6, 8, 10, 12))}) WHERE sma IS NOT NULL")
sim_ctes("cross", "sleeves", "sleeve_trend", "macro_panel", CROSS, "CASE asset WHEN 'equity' THEN 0.0010::DOUBLE ELSE 0.0015::DOUBLE END / 252.0::DOUBLE")


def cross_inputs(spark, sf):
    panel = stage(macro_panel(spark, sf), "macro")
    both = PF.bond_returns(panel)
    long = both.select("date", F.explode(F.create_map(F.lit("equity"), "equity_ret", F.lit("bond"), "bond_ret")).alias("asset", "ret"))
    return panel, PF.complete_dates(long)


def cross_targets(days):
    return PF.targets(PF.month_signals(days, [v["sma_months"] for v in CROSS]), CROSS)


def cross_daily(spark, sf):
    panel, days = cross_inputs(spark, sf)
    days = stage(days, "days")
    per_asset = F.create_map(*[F.lit(x) for kv in CROSS_EXPENSE.items() for x in kv])
    return PF.simulate(days, panel, stage(cross_targets(days), "targets"), F.element_at(per_asset, F.col("asset")) / EQUITY_DAYS)


@query("pnl11_long_or_cash", f"SELECT {_DAILY_SQL} FROM cross_daily")
def pnl11(spark, sf):
    return round_to(cross_daily(spark, sf).select("variant", "date", "month_no", *_DAILY), 8, *_DAILY)


@query("pnl22_position_log", """
SELECT variant, signal_date, count(*) FILTER (target > 0) AS n_active, coalesce(string_agg(asset, ',' ORDER BY asset) FILTER (target > 0), '') AS held FROM cross_target GROUP BY 1, 2""")
def pnl22(spark, sf):
    return PF.position_log(cross_targets(cross_inputs(spark, sf)[1])).withColumn("held", F.array_join("held", ","))


_SUMMARY = ("gross_gain", "net_gain", "cost_paid", "time_in_market", "mean_turnover", "max_invested")


@query("scr25_portfolio_cost_share", f"""
SELECT *, round(CASE WHEN gross_gain > 0 THEN cost_paid / gross_gain END, 7) AS cost_share FROM (
  SELECT variant, count(*) AS n_days, product(1 + gross_ret) - 1 AS gross_gain, product(1 + net_ret) - 1 AS net_gain, sum(cost_paid) AS cost_paid,
         avg((invested_target > 0)::INT) AS time_in_market, avg(turnover) AS mean_turnover, max(invested_target) AS max_invested FROM cross_daily GROUP BY 1)
""".replace("SELECT *, round", "SELECT variant, n_days, " + ", ".join(f"round({c}, 7) AS {c}" for c in _SUMMARY) + ", round", 1))
def scr25(spark, sf):
    out = PF.summary(cross_daily(spark, sf)).withColumn("cost_share", S.cost_share(F.col("cost_paid"), F.col("gross_gain")))
    return round_to(out, 7, *_SUMMARY, "cost_share")


cte("cross_series", "SELECT variant AS series_id, row_number() OVER (PARTITION BY variant ORDER BY date) - 1 AS idx, date AS dt, excess_ret AS ret FROM cross_daily")
score_ctes("crossv", "cross_series")


@query("scr24_sleeve_attribution", "SELECT series_id, n, round(sr, 6) AS sr, effective_t, round(psr0, 6) AS psr0 FROM crossv_score WHERE status = 'ok'")
def scr24(spark, sf):
    """The rule on all assets, with other lengths, and on each asset alone."""
    series = stage(PF.as_series(cross_daily(spark, sf), "excess_ret"), "series")
    out = S.score_series(series).filter("status = 'ok'").select("series_id", "n", "sr", "effective_t", "psr0")
    return round_to(out, 6, "sr", "psr0")


_LADDER = psr_of(
    f"""(SELECT *, {max_sharpe('v_sr', 'trials')} AS s FROM (SELECT m.*, v_sr, trials::DOUBLE AS trials FROM crossv_score m,
    (SELECT var_samp(sr) AS v_sr FROM crossv_score WHERE series_id IN ('all', 'sma6', 'sma8', 'sma12')), (VALUES (8), (16), (32)) v(trials) WHERE series_id = 'all'))""",
    "trials, v_sr", "sr", "s", "effective_t", "skew", "kurt", "p")


@query("scr22_length_variants", f"SELECT trials::INTEGER AS trials, round(v_sr, 10) AS v_sr, round(p, 6) AS dsr FROM ({_LADDER})")
def scr22(spark, sf):
    series = stage(PF.as_series(cross_daily(spark, sf), "excess_ret"), "series")
    scores = stage(S.score_series(series).withColumn("study", F.lit("cross")), "scores")
    family = scores.filter(F.col("series_id").isin("all", "sma6", "sma8", "sma12"))
    out = S.deflation_ladder(scores.filter("series_id = 'all'"), family.select("study", "sr"), (8, 16, 32), ["study"])
    return round_to(round_to(out.select("trials", "v_sr", "dsr"), 10, "v_sr"), 6, "dsr")


cte("sector_diff", """
SELECT s.variant AS series_id, row_number() OVER (PARTITION BY s.variant ORDER BY date) - 1 AS idx, s.net_ret - a.net_ret AS ret
FROM sector_daily s JOIN (SELECT date, net_ret FROM sector_daily WHERE variant = 'always') a USING (date) WHERE variant IN ('ma10', 'cost10', 'cost20', 'top3')""")
score_ctes("sdiff", "sector_diff")


@query("scr23_cost_sensitivity", "SELECT series_id, n, round(sr, 6) AS sr, round(psr0, 6) AS psr0 FROM sdiff_score")
def scr23(spark, sf):
    """Timing significance at several turnover costs and breadths, against the always-invested twin."""
    daily = stage(sector_daily(spark, sf).select("variant", "date", "net_ret"), "sectors")
    base = daily.filter("variant = 'always'").select("date", F.col("net_ret").alias("_base"))
    diff = daily.filter(F.col("variant").isin("ma10", "cost10", "cost20", "top3")).join(base, "date")
    series = PF.as_series(diff.withColumn("diff", F.col("net_ret") - F.col("_base")), "diff")
    return round_to(S.score_series(series).select("series_id", "n", "sr", "psr0"), 6, "sr", "psr0")


# ---- volatility-managed ---------------------------------------------------------------------------

VM_SPECS = [
    VM.spec("net", burn_in=24), VM.spec("rv2", "rv2"), VM.spec("rv3", "rv3"), VM.spec("ewma", "ewma"), VM.spec("cap15", cap=1.5), VM.spec("cap10", cap=1.0),
    VM.spec("fin05", financing=0.005), VM.spec("fin20", financing=0.020), VM.spec("expanding", expanding=True, burn_in=24),
]
VM_SPECS += [VM.costless("uncapped", 1.0e9, VM_SPECS[0]), VM.costless("capped", 2.0, VM_SPECS[0])]
FACTOR_SPECS = [
    VM.spec("net", expense=0.0, financing=0.0), VM.spec("expanding", expense=0.0, financing=0.0, expanding=True, burn_in=24),
]
FACTOR_SPECS += [VM.costless("uncapped", 1.0e9, FACTOR_SPECS[0]), VM.costless("capped", 2.0, FACTOR_SPECS[0])]

cte("excess_base", """
SELECT asset AS series_id, date, ret - 0.0001 AS excess, 0.0001::DOUBLE AS cash_ret FROM asset_ret UNION ALL
SELECT 'market', date, equity_ret - cash_ret, cash_ret FROM macro_panel""")
cte("factor_base", "SELECT factor AS series_id, date, ret AS excess, 0.0::DOUBLE AS cash_ret FROM factors")


def vm_ctes(p: str, base: str, specs) -> None:
    """Declare `<p>_managed` for a table (series_id, date, excess, cash_ret)."""
    cte(f"{p}_days", f"SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY date_trunc('month', date)) - 1 AS month_no, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM {base}")
    cte(f"{p}_ewma", f"""
SELECT series_id, rn, excess * excess AS v FROM {p}_days WHERE rn = 1 UNION ALL
SELECT d.series_id, d.rn, 0.94::DOUBLE * e.v + 0.06::DOUBLE * d.excess * d.excess FROM {p}_ewma e JOIN {p}_days d ON d.series_id = e.series_id AND d.rn = e.rn + 1""", recursive=True)
    cte(f"{p}_mv", f"""
SELECT series_id, month_no, sum(excess * excess) AS s, arg_max(v, rn) AS last FROM {p}_days JOIN {p}_ewma USING (series_id, rn) GROUP BY 1, 2""")
    parts = [
        f"SELECT series_id, month_no, 'rv{k}' AS estimator, CASE WHEN count(*) OVER w = {k} THEN sum(s) OVER w END AS variance FROM {p}_mv "
        f"WINDOW w AS (PARTITION BY series_id ORDER BY month_no ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 2, 3)
    ]
    parts.append(f"SELECT series_id, month_no, 'ewma', 21.0 * lag(last) OVER (PARTITION BY series_id ORDER BY month_no) FROM {p}_mv")
    cte(f"{p}_var", f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE variance > 0")
    cte(f"{p}_scored", f"""
SELECT *, stddev_pop(excess) OVER a / stddev_pop(raw) OVER a AS c_full, stddev_pop(excess) OVER b / nullif(stddev_pop(raw) OVER b, 0) AS c_past,
       count(*) OVER b AS seen, min(month_no) OVER a AS first_month
FROM (SELECT d.*, estimator, variance, excess / variance AS raw FROM {p}_days d JOIN {p}_var v ON d.series_id = v.series_id AND d.month_no = v.month_no)
WINDOW a AS (PARTITION BY series_id, estimator),
       b AS (PARTITION BY series_id, estimator ORDER BY month_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
    rows = ", ".join(
        f"('{s['variant']}', '{s['estimator']}', {s['cap']!r}::DOUBLE, {s['expense']!r}::DOUBLE, {s['financing']!r}::DOUBLE, {s['turnover_cost']!r}::DOUBLE, {s['expanding']}, {s['burn_in']})" for s in specs)
    cte(f"{p}_weight", f"""
SELECT *, month_no IS DISTINCT FROM lag(month_no) OVER w AS fresh, lag(weight) OVER w AS w0 FROM (
  SELECT d.*, v.* EXCLUDE (est), CASE WHEN expanding AND (month_no - first_month < burn_in OR seen < 2) THEN 1.0
    ELSE greatest(0, least(cap, CASE WHEN expanding THEN c_past ELSE c_full END / variance)) END AS weight
  FROM {p}_scored d JOIN (VALUES {rows}) v(variant, est, cap, expense, financing, turnover_cost, expanding, burn_in) ON estimator = est)
WINDOW w AS (PARTITION BY series_id, variant ORDER BY date)""")
    cte(f"{p}_managed", f"""
SELECT *, managed - unmanaged AS difference, managed + cash_ret AS managed_total FROM (
  SELECT *, weight * excess - fin - exp_paid - coalesce(turnover, 0) * turnover_cost AS managed, excess - expense / 252.0 AS unmanaged FROM (
    SELECT *, CASE WHEN fresh THEN abs(weight - coalesce(w0, 1.0)) END AS turnover, financing / 252.0 * greatest(weight - 1, 0) AS fin, expense / 252.0 * weight AS exp_paid FROM {p}_weight))""")


vm_ctes("vm", "excess_base", VM_SPECS)
vm_ctes("fac", "factor_base", FACTOR_SPECS)


def excess_base(spark, sf):
    assets = asset_ret(spark, sf).select(F.col("asset").alias("series_id"), "date", (F.col("ret") - 0.0001).alias("excess"), F.lit(0.0001).alias("cash_ret"))
    market = macro_panel(spark, sf).select(F.lit("market").alias("series_id"), "date", (F.col("equity_ret") - F.col("cash_ret")).alias("excess"), "cash_ret")
    return assets.unionByName(market)


def managed(spark, sf):
    return VM.managed_series(stage(excess_base(spark, sf), "excess"), VM_SPECS)


def managed_factors(spark, sf):
    base = factors(spark, sf).select(F.col("factor").alias("series_id"), "date", F.col("ret").alias("excess"), F.lit(0.0).alias("cash_ret"))
    return VM.managed_series(stage(base, "factors"), FACTOR_SPECS)


@query("win16_prior_variance", "SELECT series_id, month_no, estimator, round(variance, 10) AS variance FROM vm_var")
def win16(spark, sf):
    return round_to(VM.prior_variance(excess_base(spark, sf), ["rv1", "rv2", "rv3", "ewma"]), 10, "variance")


@query("pnl16_managed_weights", "SELECT series_id, variant, month_no, round(any_value(weight), 7) AS weight FROM vm_managed WHERE fresh GROUP BY 1, 2, 3")
def pnl16(spark, sf):
    out = managed(spark, sf).filter("turnover IS NOT NULL").select("series_id", "variant", "month_no", "weight")
    return round_to(out, 7, "weight")


@query("pnl17_managed_series", """
SELECT series_id, variant, date, round(managed, 8) AS managed, round(unmanaged, 8) AS unmanaged, round(difference, 8) AS difference, round(managed_total, 8) AS managed_total FROM vm_managed""")
def pnl17(spark, sf):
    cols = ("managed", "unmanaged", "difference", "managed_total")
    return round_to(managed(spark, sf).select("series_id", "variant", "date", *cols), 8, *cols)


_EXPOSURE = ("mean_weight", "max_weight", "frac_capped", "frac_levered", "mean_turnover", "financing_cost", "turnover_cost", "expense_cost")


@query("pnl17_exposure_summary", f"""
SELECT series_id, variant, n_days, round(c, 9) AS scale, {', '.join(f'round({c}, 6) AS {c}' for c in _EXPOSURE)} FROM (
  SELECT series_id, variant, count(*) AS n_days, any_value(c_full) AS c, avg(weight) AS mean_weight, max(weight) AS max_weight, avg((weight >= cap - 1e-12)::INT) AS frac_capped,
         avg((weight > 1 + 1e-12)::INT) AS frac_levered, avg(turnover) AS mean_turnover, sum(fin) AS financing_cost, sum(coalesce(turnover, 0) * turnover_cost) AS turnover_cost, sum(exp_paid) AS expense_cost
  FROM vm_managed WHERE cap < 100 GROUP BY 1, 2)""")
def pnl17_summary(spark, sf):
    out = VM.exposure_summary(managed(spark, sf).filter("cap < 100"))
    return round_to(round_to(out, 6, *_EXPOSURE), 9, "scale")


cte("vm_parts", """
SELECT *, capped - uncapped AS cap_drag, net - capped AS cost_drag FROM (
  SELECT series_id, avg(difference) FILTER (variant = 'uncapped') * 252 AS uncapped, avg(difference) FILTER (variant = 'capped') * 252 AS capped,
         avg(difference) FILTER (variant = 'net') * 252 AS net FROM vm_managed GROUP BY 1)""")
_PARTS = ("uncapped", "capped", "net", "cap_drag", "cost_drag")


@query("pnl18_gross_decomposition", f"SELECT series_id, {', '.join(f'round({c}, 7) AS {c}' for c in _PARTS)} FROM vm_parts")
def pnl18(spark, sf):
    return round_to(VM.gross_decomposition(managed(spark, sf)), 7, *_PARTS)


cte("vm_diff", "SELECT series_id || '/' || variant AS series_id, row_number() OVER (PARTITION BY series_id, variant ORDER BY date) - 1 AS idx, difference AS ret FROM vm_managed")
score_ctes("vmd", "vm_diff")


@query("scr23_cap_and_financing", "SELECT series_id, n, round(sr, 6) AS sr, effective_t, round(psr0, 6) AS psr0 FROM vmd_score WHERE status = 'ok'")
def scr23_vm(spark, sf):
    """Significance of the managed difference across caps, financing spreads, estimators and scaling."""
    series = stage(VM.as_series(managed(spark, sf)), "series")
    out = S.score_series(series).filter("status = 'ok'").select("series_id", "n", "sr", "effective_t", "psr0")
    return round_to(out, 6, "sr", "psr0")


cte("fac_diff", "SELECT series_id || '/' || variant AS series_id, row_number() OVER (PARTITION BY series_id, variant ORDER BY date) - 1 AS idx, difference AS ret FROM fac_managed WHERE variant IN ('net', 'expanding')")
score_ctes("facd", "fac_diff")


@query("pnl19_factor_asymmetry", """
SELECT split_part(series_id, '/', 1) AS factor, split_part(series_id, '/', 2) AS variant, n, effective_t, round(sr * sqrt(252), 6) AS ann_sharpe, round(psr0, 6) AS psr0, psr0 >= 0.95 AS passes FROM facd_score""")
def pnl19(spark, sf):
    series = stage(VM.as_series(managed_factors(spark, sf).filter("variant IN ('net', 'expanding')")), "series")
    out = S.score_series(series)
    return out.select(
        F.split("series_id", "/")[0].alias("factor"), F.split("series_id", "/")[1].alias("variant"), "n", "effective_t",
        F.round(F.col("sr") * EQUITY_DAYS**0.5, 6).alias("ann_sharpe"), F.round("psr0", 6).alias("psr0"), (F.col("psr0") >= 0.95).alias("passes"),
    )


@query("pnl19_asymmetry_verdict", """
SELECT *, market_passes AND n_failing >= 4 AS asymmetry_confirmed, CASE WHEN NOT market_passes AND n_failing = n_factors THEN 'uniform_null' WHEN NOT market_passes THEN 'market_fails'
  WHEN n_failing >= 4 THEN 'confirmed' ELSE 'partial' END AS finding
FROM (SELECT bool_or(s = 'market' AND ok) AS market_passes, count(*) FILTER (s <> 'market' AND NOT ok) AS n_failing, count(*) FILTER (s <> 'market') AS n_factors, arg_max(s, psr0) FILTER (s <> 'market') AS best
  FROM (SELECT *, coalesce(psr0 >= 0.95, false) AS ok FROM (SELECT 'market' AS s, psr0 FROM vmd_score WHERE series_id = 'market/net' UNION ALL SELECT split_part(series_id, '/', 1), psr0 FROM facd_score WHERE ends_with(series_id, '/net'))))""")
def pnl19_verdict(spark, sf):
    market = managed(spark, sf).filter("series_id = 'market' AND variant = 'net'")
    both = VM.as_series(market.unionByName(managed_factors(spark, sf).filter("variant = 'net'")))
    series = stage(both.withColumn("series_id", F.split("series_id", "/")[0]), "series")
    return VM.asymmetry(S.score_series(series).select("series_id", "psr0"), "market")


# ---- static tilt ----------------------------------------------------------------------------------

DIFFERENTIAL = 0.0011 / EQUITY_DAYS


@query("pnl20_tilt_difference", f"""
SELECT portfolio, date, round(ret - (mkt_rf + rf) - {DIFFERENTIAL!r}, 9) AS difference, round(ret - (mkt_rf + rf), 9) AS gross FROM tilt_panel""")
def pnl20(spark, sf):
    net = RG.tilt_difference(tilt_panel(spark, sf), DIFFERENTIAL)
    return net.select("portfolio", "date", F.round("difference", 9).alias("difference"), F.round(F.col("difference") + DIFFERENTIAL, 9).alias("gross"))


_X = ["1.0::DOUBLE", "mkt_rf", "smb", "hml", "rmw", "cma", "(ret - rf)"]
_GRAM = ", ".join(f"sum({_X[i]} * {_X[j]})" for i in range(7) for j in range(i, 7))


@query("sig11_gram", f"SELECT portfolio, unnest(range(0, 28)) AS pos, round(unnest([{_GRAM}]), 8) AS value FROM tilt_panel GROUP BY 1")
def sig11_gram(spark, sf):
    g = RG.gram(tilt_panel(spark, sf), F.col("ret") - F.col("rf"))
    return g.select("portfolio", F.posexplode("sums").alias("pos", "value")).select("portfolio", F.col("pos").cast("bigint").alias("pos"), F.round("value", 8).alias("value"))


def sweep(step: int) -> str:
    """One elimination step on the upper triangle of the product sums, in place: pivot `step`."""
    def at(i: int, j: int) -> str:
        return f"a{min(i, j)}{max(i, j)}"

    d, out = at(step, step), []
    for i in range(7):
        for j in range(i, 7):
            if step not in (i, j):
                new = f"{at(i, j)} - {at(i, step)} * {at(step, j)} / {d}"
            else:
                new = f"-1.0::DOUBLE / {d}" if i == j else f"{at(i, j)} / {d}"
            out.append(f"{new} AS {at(i, j)}")
    return f"SELECT portfolio, {', '.join(out)} FROM solve{step}"


cte("solve0", "SELECT portfolio, " + ", ".join(f"sum({_X[i]} * {_X[j]}) AS a{i}{j}" for i in range(7) for j in range(i, 7)) + " FROM tilt_panel GROUP BY 1")
for _step in range(6):
    cte(f"solve{_step + 1}", sweep(_step))
# a06 to a56 are now the coefficients, and a00 to a05 the first row of the negative inverse
cte("tilt_score", f"""
SELECT p.portfolio, row_number() OVER (PARTITION BY p.portfolio ORDER BY date) AS t, count(*) OVER (PARTITION BY p.portfolio) AS n,
       -({" + ".join(f"a0{i} * {x}" for i, x in enumerate(_X[:6]))}) * ({_X[6]} - ({" + ".join(f"a{i}6 * {x}" for i, x in enumerate(_X[:6]))})) AS u
FROM tilt_panel p JOIN solve6 s ON p.portfolio = s.portfolio""")
cte("tilt_lag", "SELECT *, greatest(1, floor(4 * power(n / 100.0, 2.0::DOUBLE / 9)))::BIGINT AS lag FROM tilt_score")
cte("tilt_var", """
SELECT portfolio, n, lag, sum(CASE WHEN l = 0 THEN 1.0 ELSE 2 * (1.0 - l / (lag + 1.0)) END * uu) AS v FROM (
  SELECT a.portfolio, a.n, a.lag, a.l, sum(a.u * b.u) AS uu FROM (SELECT *, unnest(range(0, lag + 1)) AS l FROM tilt_lag) a
  JOIN tilt_lag b ON a.portfolio = b.portfolio AND b.t = a.t - a.l GROUP BY ALL) GROUP BY 1, 2, 3""")
cte("tilt_fit", """
SELECT portfolio, n, lag, a06 AS alpha, CASE WHEN v > 0 THEN a06 / sqrt(v) ELSE 0 END AS alpha_t, a16 AS mkt_rf, a26 AS smb, a36 AS hml, a46 AS rmw, a56 AS cma
FROM solve6 JOIN tilt_var USING (portfolio)""")


@query("sig11_factor_regression", """
SELECT portfolio, n, lag, round(alpha, 9) AS alpha, round(alpha * 252, 7) AS alpha_ann, round(alpha_t, 5) AS alpha_t, round(mkt_rf, 7) AS beta_mkt_rf,
       round(smb, 7) AS beta_smb, round(hml, 7) AS beta_hml, round(rmw, 7) AS beta_rmw, round(cma, 7) AS beta_cma,
       CASE WHEN best > 0 THEN CASE best WHEN smb THEN 'smb' WHEN hml THEN 'hml' WHEN rmw THEN 'rmw' ELSE 'cma' END END AS dominant_tilt
FROM (SELECT *, greatest(smb, hml, rmw, cma) AS best FROM tilt_fit)""")
def sig11(spark, sf):
    out = RG.factor_regression(stage(tilt_panel(spark, sf), "tilt"))
    betas = [f"beta_{f}" for f in RG.FACTORS]
    return round_to(round_to(round_to(out, 9, "alpha"), 7, "alpha_ann", *betas), 5, "alpha_t")


@query("scr29_factor_decomposition", """
SELECT portfolio, round(d * 252, 7) AS raw_difference, round(alpha * 252, 7) AS alpha_ann, round(f.rmw * m.rmw * 252, 7) AS factor_part
FROM tilt_fit f JOIN (SELECT portfolio, avg(ret - (mkt_rf + rf)) AS d, avg(rmw) AS rmw FROM tilt_panel GROUP BY 1) m USING (portfolio)""")
def scr29_factor(spark, sf):
    panel = stage(tilt_panel(spark, sf), "tilt")
    return round_to(RG.return_decomposition(panel, RG.factor_regression(panel)), 7, "raw_difference", "alpha_ann", "factor_part")


# ---- weekly volatility-capped trend ---------------------------------------------------------------

SMA, VOL, COST, START = 200, 60, 0.0028, "1995-06-01"
cte("trend_days", """
SELECT *, epoch(date)::BIGINT // 86400 AS d FROM bars_strict""")
cte("trend_ret", "SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY symbol ORDER BY d) = 1 THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY d)) END AS lr FROM trend_days")
cte("trend_sig", f"""
SELECT *, coalesce(n_sma = {SMA} AND n_vol = {VOL + 1} AND close > sma AND vol > 0, false) AS active FROM (
  SELECT *, CASE WHEN n_sma = {SMA} THEN sma_ END AS sma, CASE WHEN n_lr = {VOL} AND lr IS NOT NULL THEN sd * sqrt(365) END AS vol FROM (
    SELECT *, count(*) OVER a AS n_sma, avg(close) OVER a AS sma_, count(*) OVER c AS n_vol, count(lr) OVER b AS n_lr, stddev_samp(lr) OVER b AS sd FROM trend_ret
    WINDOW a AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN {SMA - 1} PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN {VOL - 1} PRECEDING AND CURRENT ROW),
           c AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN {VOL} PRECEDING AND CURRENT ROW)))""")


def trend_signals(spark, sf):
    return WT.strict_signals(bars_strict(spark, sf), SMA, VOL)


@query("win15_strict_windows", "SELECT symbol, date, round(sma, 7) AS sma, round(vol, 7) AS vol, active FROM trend_sig")
def win15(spark, sf):
    return round_to(trend_signals(spark, sf).select("symbol", "date", "sma", "vol", "active"), 7, "sma", "vol")


@query("jn10_pair_covariance", f"""
SELECT symbol_a, symbol_b, date, CASE WHEN count(*) OVER w = {VOL} THEN round(covar_samp(ra, rb) OVER w * 365, 8) END AS cov FROM (
  SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.date, a.lr AS ra, b.lr AS rb FROM trend_ret a JOIN trend_ret b ON a.date = b.date
  WHERE a.symbol < b.symbol AND a.lr IS NOT NULL AND b.lr IS NOT NULL)
WINDOW w AS (PARTITION BY symbol_a, symbol_b ORDER BY date ROWS {VOL - 1} PRECEDING)""")
def jn10(spark, sf):
    """Rolling covariance of every pair of symbols."""
    return round_to(WT.rolling_covariance(trend_signals(spark, sf), None, VOL), 8, "cov")


cte("sundays", """
SELECT *, inv / sum(inv) OVER (PARTITION BY date) AS base FROM (
  SELECT date, symbol, vol, active, CASE WHEN active THEN 1.0 / vol END AS inv, count(*) OVER (PARTITION BY date) AS n FROM trend_sig WHERE dayofweek(date) = 0) WHERE n = 3""")
cte("book_var", f"""
SELECT x.date, sqrt(sum(x.base * y.base * c)) AS book FROM sundays x JOIN sundays y ON x.date = y.date JOIN (
  SELECT s.date, a.symbol AS sa, b.symbol AS sb, covar_samp(a.lr, b.lr) * 365 AS c FROM (SELECT DISTINCT date FROM sundays) s
  JOIN trend_ret a ON a.date BETWEEN s.date - {VOL - 1} AND s.date JOIN trend_ret b ON b.date = a.date GROUP BY 1, 2, 3) v
ON v.date = x.date AND sa = x.symbol AND sb = y.symbol WHERE x.active AND y.active GROUP BY 1""")
cte("week_target", """
SELECT s.date AS signal_date, symbol, coalesce(base * scale, 0) AS target, coalesce(book * scale, 0) AS est_vol, coalesce(sum(base * vol) OVER (PARTITION BY s.date) * scale, 0) AS corr_one_vol,
       count(*) FILTER (active) OVER (PARTITION BY s.date) AS n_active
FROM sundays s LEFT JOIN (SELECT *, CASE WHEN book > 0 THEN least(1.0, 0.25 / book) ELSE 0 END AS scale FROM book_var) b USING (date)""")


def week_target(spark, sf, signals=None):
    return WT.weekly_targets(signals if signals is not None else trend_signals(spark, sf), 3, VOL)


@query("pnl13_weekly_targets", "SELECT signal_date, symbol, round(target, 8) AS target, round(est_vol, 8) AS est_vol, round(corr_one_vol, 8) AS corr_one_vol, n_active FROM week_target")
def pnl13_targets(spark, sf):
    return round_to(week_target(spark, sf), 8, "target", "est_vol", "corr_one_vol")


cte("week_fill", f"""
SELECT *, exit_open / fill_open - 1 AS asset_ret FROM (
  SELECT t.*, f.open AS fill_open, e.open AS exit_open, signal_date + 1 AS fill_date, signal_date + 8 AS exit_date, count(*) OVER (PARTITION BY signal_date) AS n
  FROM week_target t JOIN bars_strict f ON f.symbol = t.symbol AND f.date = signal_date + 1 JOIN bars_strict e ON e.symbol = t.symbol AND e.date = signal_date + 8)
WHERE n = 3 AND fill_date >= DATE '{START}'""")
cte("week_result", f"""
SELECT *, wealth_before * cost_fraction AS cost_paid FROM (
  SELECT *, coalesce(product(1 + net_return) OVER (ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS wealth_before FROM (
    SELECT signal_date, fill_date, exit_date, turnover, hold AS gross_return, tg AS target_gross, pg AS pretrade_gross, n_active, est_vol, turnover * {COST} AS cost_fraction, (1 - turnover * {COST}) * (1 + hold) - 1 AS net_return FROM (
      SELECT signal_date, fill_date, exit_date, sum(abs(target - pre)) AS turnover, any_value(hold) AS hold, sum(target) AS tg, sum(pre) AS pg, any_value(n_active) AS n_active, any_value(est_vol) AS est_vol FROM (
        SELECT *, coalesce(lag(target * (1 + asset_ret) / (1 + hold)) OVER (PARTITION BY symbol ORDER BY signal_date), 0) AS pre FROM (
          SELECT *, sum(target * asset_ret) OVER (PARTITION BY signal_date) AS hold FROM week_fill)) GROUP BY 1, 2, 3)))""")
_WEEK = ("turnover", "gross_return", "net_return", "cost_fraction", "cost_paid", "wealth_before", "target_gross", "pretrade_gross")


def week_tables(spark, sf):
    bars = stage(bars_strict(spark, sf), "bars")
    filled = WT.with_fills(week_target(spark, sf, WT.strict_signals(bars, SMA, VOL)), bars, 3, START)
    filled = stage(filled, "fills")
    return bars, filled, WT.weekly_results(filled, COST)


@query("pnl13_weekly_results", f"SELECT signal_date, fill_date, exit_date, n_active, {', '.join(f'round({c}, 8) AS {c}' for c in _WEEK)} FROM week_result")
def pnl13(spark, sf):
    weeks = week_tables(spark, sf)[2]
    return round_to(weeks.select("signal_date", "fill_date", "exit_date", "n_active", *_WEEK), 8, *_WEEK)


cte("week_marks", """
WITH s AS (SELECT *, wealth_before * (1 - cost_fraction) AS w, greatest(0, 1 - target_gross) AS cash FROM week_result)
SELECT signal_date, fill_date AS date, 'fill_after_cost' AS kind, 0 AS ord, w AS equity FROM s UNION ALL
SELECT signal_date, exit_date, 'exit_open', 2, w * (1 + gross_return) FROM s UNION ALL
SELECT s.signal_date, f.date, 'daily_close', 1, CASE WHEN count(b.close) = 3 THEN any_value(w) * (any_value(cash) + sum(f.target * b.close / f.fill_open)) END
FROM s JOIN (SELECT *, unnest([fill_date + i::INTEGER for i in range(0, 7)]) AS date FROM week_fill) f ON f.signal_date = s.signal_date
LEFT JOIN bars_strict b ON b.symbol = f.symbol AND b.date = f.date GROUP BY 1, 2""")


@query("pnl14_daily_marks", "SELECT signal_date, date, kind, ord, round(equity, 8) AS equity FROM week_marks ")
def pnl14(spark, sf):
    bars, filled, weeks = week_tables(spark, sf)
    return round_to(WT.daily_marks(filled, weeks, bars, strict=False), 8, "equity")


@query("pnl14_path_drawdown", """
SELECT round(max(1 - equity / peak), 8) AS max_drawdown FROM (SELECT *, greatest(1.0, max(equity) OVER (ORDER BY signal_date, date, ord)) AS peak FROM week_marks)""")
def pnl14_drawdown(spark, sf):
    bars, filled, weeks = week_tables(spark, sf)
    path = WT.daily_marks(filled, weeks, bars, strict=False).withColumn("series_id", F.lit("trend"))
    return round_to(R.max_drawdown(path, "equity", ["signal_date", "date", "ord"]).drop("series_id"), 8, "max_drawdown")


@query("pnl14_missing_closes", """
SELECT signal_date, f.symbol, f.date FROM (SELECT *, unnest([fill_date + i::INTEGER for i in range(0, 7)]) AS date FROM week_fill) f
ANTI JOIN bars_strict b ON b.symbol = f.symbol AND b.date = f.date""")
def pnl14_missing(spark, sf):
    """The days on which strict daily marks fail."""
    bars, filled, _ = week_tables(spark, sf)
    return WT.missing_closes(filled, bars).select("signal_date", "symbol", "date")


cte("trend_span", "SELECT min(date) AS a, max(date) AS z FROM (SELECT date FROM bars_strict GROUP BY 1 HAVING count(*) = 3)")


@query("pnl15_buy_and_hold", """
SELECT date, round(sum(CASE WHEN date = z THEN b.open ELSE close END / base / 3), 8) AS equity, count(*) AS n_marked
FROM bars_strict b JOIN trend_span ON date BETWEEN a AND z JOIN (SELECT symbol, open AS base FROM bars_strict JOIN trend_span ON date = a) USING (symbol) GROUP BY 1""")
def pnl15(spark, sf):
    """From the first day that all three symbols have to the last."""
    bars = stage(bars_strict(spark, sf), "bars")
    common = bars.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("n = 3")
    first, last = common.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return round_to(WT.buy_and_hold(bars, first, last, 3), 8, "equity")


@query("pnl15_missing_starts", """
SELECT symbol, min(date) AS first_open FROM (SELECT replace(symbol, '#', '') AS symbol, date FROM bars, (SELECT min(date) AS a FROM bars) WHERE date >= a) GROUP BY 1 HAVING min(date) > (SELECT min(date) FROM bars)""")
def pnl15_missing(spark, sf):
    """Symbols that a strict path from the first day on refuses, since they have no open on it."""
    rows = stage(bars(spark, sf).withColumn("symbol", F.replace("symbol", F.lit("#"), F.lit(""))), "bars")
    first, last = rows.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return WT.missing_starts(rows, first, last)


cte("week_series", "SELECT 'trend/' || grp AS series_id, row_number() OVER (PARTITION BY grp ORDER BY signal_date) - 1 AS idx, ret FROM (SELECT signal_date, net_return AS ret, unnest([0]) AS grp FROM week_result)")
score_ctes("weekt", "week_series")


@query("scr26_trend_verdict", """
SELECT n, effective_t, round(psr0, 6) AS psr0, round(g, 7) AS gross_gain, round(c, 7) AS cost_paid, round(CASE WHEN g > 0 THEN c / g END, 6) AS cost_share, round(m, 7) AS max_target,
       CASE WHEN psr0 >= 0.95 AND coalesce(c / nullif(greatest(g, 0), 0) <= 0.25, false) AND m <= 1 + 1e-12 THEN 'not_killed' ELSE 'non_viable' END AS verdict
FROM weekt_score, (SELECT product(1 + gross_return) - 1 AS g, sum(cost_paid) AS c, max(target_gross) AS m FROM week_result)""")
def scr26(spark, sf):
    weeks = stage(week_tables(spark, sf)[2].withColumn("series_id", F.lit("trend")), "weeks")
    series = weeks.select("series_id", (F.row_number().over(over(["series_id"], "signal_date")) - 1).alias("idx"), F.col("net_return").alias("ret"))
    facts = weeks.groupBy("series_id").agg(
        R.compounded(F.col("gross_return")).alias("gross_gain"), F.sum("cost_paid").alias("cost_paid"), F.max("target_gross").alias("max_target")
    )
    facts = facts.withColumn("cost_share", S.cost_share(F.col("cost_paid"), F.col("gross_gain")))
    out = S.verdict(S.score_series(series).join(facts, "series_id"), {"psr0": 0.95, "cost_share": 0.25, "max_target": 1.0})
    out = out.select("n", "effective_t", "psr0", "gross_gain", "cost_paid", "cost_share", "max_target", "verdict")
    return round_to(round_to(out, 6, "psr0", "cost_share"), 7, "gross_gain", "cost_paid", "max_target")


@query("jn07_panel_intersection", """
SELECT b.date, round(mkt_rf, 9) AS mkt_rf, round(rmw, 9) AS rmw, round(wml, 9) AS wml, round(bond_yield, 9) AS bond_yield FROM tilt_base b
JOIN (SELECT date, ret AS wml FROM factors WHERE factor = 'wml') m USING (date) JOIN rate_curve USING (date)""")
def jn07(spark, sf):
    tilt = tilt_base(spark, sf).select("date", "mkt_rf", "rmw")
    momentum = factors(spark, sf).filter("factor = 'wml'").select("date", F.col("ret").alias("wml"))
    return round_to(tilt.join(momentum, "date").join(rate_curve(spark, sf), "date"), 9, "mkt_rf", "rmw", "wml", "bond_yield")


@query("set02_common_dates", "SELECT date FROM bars_strict WHERE symbol = 'A' INTERSECT SELECT date FROM bars_strict WHERE symbol = 'N' INTERSECT SELECT date FROM bars_strict WHERE symbol = 'R'")
def set02(spark, sf):
    bars = bars_strict(spark, sf)
    days = [bars.filter(F.col("symbol") == s).select("date") for s in ("A", "N", "R")]
    return days[0].intersect(days[1]).intersect(days[2])
