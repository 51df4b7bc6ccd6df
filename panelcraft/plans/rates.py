"""As-of joins, carried rates and cross-sectional dispersion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import annualize_rate
from ..functions.windows import over
from ..operators import asof as A
from ..operators import bootstrap as B
from ..operators import dispersion as D
from ..operators import panel as P
from ..operators.returns import linear_trend
from .inputs import all_quotes, funding, quotes, round_to, settled, table
from .registry import cte, query
from .scores import PATHS, boot_ctes
from .sqltext import score_ctes
from .stage import stage

GAP_DAYS = 10
SEED = 20260607

cte("order_bars", """
SELECT 'C' || (o_custkey % 40) AS symbol, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS dollar_volume FROM orders GROUP BY 1, 2""")
cte("order_weeks", """
SELECT symbol, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, sum(dollar_volume) AS v FROM order_bars GROUP BY 1, 2""")
cte("order_pairs", """
SELECT week_end, symbol FROM (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY tv DESC, symbol) AS rn FROM (
  SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY week_end) AS bars,
         avg(v) OVER (PARTITION BY symbol ORDER BY week_end ROWS 3 PRECEDING) AS tv FROM order_weeks) WHERE bars >= 8) WHERE rn <= 30""")


def order_pairs(spark, sf):
    """Weekly eligible names by traded order value."""
    daily = table(spark, sf, "orders").groupBy(
        F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("symbol"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.sum("o_totalprice").alias("dollar_volume"), F.max("o_totalprice").alias("close"))
    return P.eligible_pairs(P.liquid_universe(P.weekly_panel(daily), top_n=30))


cte("asof_left", "SELECT key, ts, ingest FROM quotes WHERE kind = 'purchase'")
cte("asof_mark", "SELECT key, ts, close FROM quotes WHERE kind = 'view'")
cte("asof_spot", "SELECT key, ts, close FROM quotes WHERE kind = 'click'")


@query("jn01_asof_observations", """
SELECT key, ts, ingest, round(perp_close, 6) AS perp_close, round(spot_close, 6) AS spot_close,
       round((perp_close - spot_close) / nullif(spot_close, 0), 8) AS basis
FROM (SELECT l.key, l.ts, l.ingest, CASE WHEN l.ts - m.ts <= INTERVAL 8 HOUR THEN m.close END AS perp_close,
             CASE WHEN l.ts - s.ts <= INTERVAL 8 HOUR THEN s.close END AS spot_close
      FROM asof_left l ASOF LEFT JOIN asof_mark m ON l.key = m.key AND l.ts >= m.ts
      ASOF LEFT JOIN asof_spot s ON l.key = s.key AND l.ts >= s.ts)""")
def jn01(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {"purchase": "event", "view": "mark", "click": "spot"}.items() for x in kv])
    rows = all_quotes(spark, sf).withColumn("source", F.try_element_at(names, F.col("kind")))
    out = A.observations(rows, ["key"], keep=["ingest"], tolerance_hours=8)
    return round_to(round_to(out, 6, "perp_close", "spot_close"), 8, "basis")


cte("grid_days", """
SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (
  SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM settled)""")
cte("yearly", "SELECT symbol, ts, rate * 8760.0 / interval_hours AS annualized FROM settled")
cte("carried", """
SELECT g.symbol, g.date, CASE WHEN g.date - e.ts <= INTERVAL 10 DAY THEN annualized END AS annualized
FROM (SELECT symbol, CAST(date AS TIMESTAMP) AS date FROM grid_days, (SELECT DISTINCT symbol FROM settled)) g
ASOF LEFT JOIN yearly e ON g.symbol = e.symbol AND g.date >= e.ts""")
cte("carried_next", "SELECT symbol, CAST(date AS DATE) AS date, annualized, lead(annualized) OVER (PARTITION BY symbol ORDER BY date) AS annualized_next FROM carried")


@query("jn02_carried_grid", """
SELECT symbol, date, round(annualized, 10) AS annualized, CASE WHEN annualized IS NOT NULL THEN round(annualized_next, 10) END AS annualized_next
FROM carried_next""")
def jn02(spark, sf):
    yearly = stage(settled(spark, sf), "settled").withColumn("annualized", annualize_rate(F.col("rate"), F.col("interval_hours")))
    out = A.carried_grid(yearly.select("symbol", "ts", "annualized"), "annualized", GAP_DAYS)
    return round_to(out, 10, "annualized", "annualized_next")


_LEG = """(SELECT key, epoch_us(ts + INTERVAL 30 MINUTE) // 3600000000 * 3600000000 AS grid_us, arg_min(close, ts) AS r FROM quotes WHERE kind = '{}' GROUP BY 1, 2)"""


@query("jn03_venue_delta", f"""
SELECT key, grid_us, round(a.r, 6) AS rate_left, round(b.r, 6) AS rate_right, round(a.r - b.r, 6) AS rate_delta
FROM {_LEG.format('view')} a JOIN {_LEG.format('click')} b USING (key, grid_us)""")
def jn03(spark, sf):
    """All grid points of both venues; of several events on one the earliest counts, and `jn03_snap_collisions` lists them."""
    a, b = (quotes(spark, sf, k).withColumnRenamed("close", "rate") for k in ("view", "click"))
    return round_to(A.venue_delta(a, b, ["key"], 1, strict=False), 6, "rate_left", "rate_right", "rate_delta")


@query("jn03_snap_collisions", """
SELECT kind, key, epoch_us(ts + INTERVAL 30 MINUTE) // 3600000000 * 3600000000 AS grid_us, count(*) AS n FROM quotes WHERE kind IN ('view', 'click') GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def jn03_collisions(spark, sf):
    """Events of either venue that a strict match refuses."""
    return A.snap_collisions(all_quotes(spark, sf).filter("kind IN ('view', 'click')"), ["kind", "key"], 1)


cte("cross_section", """
SELECT c.*, n_eligible FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end FROM carried_next WHERE annualized IS NOT NULL) c
JOIN order_pairs USING (week_end, symbol) JOIN (SELECT week_end, count(*) AS n_eligible FROM order_pairs GROUP BY 1) USING (week_end)""")


def cross_section(spark, sf):
    return D.funded_cross_section(stage(settled(spark, sf), "settled"), order_pairs(spark, sf), GAP_DAYS)


@query("jn06_eligible_cross_section", """
SELECT symbol, date, week_end, n_eligible, round(annualized, 10) AS annualized, round(annualized_next, 10) AS annualized_next FROM cross_section""")
def jn06(spark, sf):
    return round_to(cross_section(spark, sf), 10, "annualized", "annualized_next")


cte("day_stats", """
SELECT date, any_value(n_eligible) AS n_eligible, count(*) AS n_funded, quantile_cont(annualized, 0.75) - quantile_cont(annualized, 0.25) AS iqr,
       stddev_samp(annualized) AS std, quantile_cont(annualized, 0.05) AS lo, quantile_cont(annualized, 0.95) AS hi
FROM cross_section GROUP BY 1 HAVING count(*) >= 5""")
cte("dispersion", """
SELECT d.date, n_eligible, n_funded, iqr, std, winsor_std, sort_premium FROM day_stats d
JOIN (SELECT c.date, stddev_samp(least(greatest(annualized, lo), hi)) AS winsor_std FROM cross_section c JOIN day_stats s ON c.date = s.date GROUP BY 1) w USING (date)
JOIN (SELECT date, avg(annualized_next) FILTER (rn > n - size) - avg(annualized_next) FILTER (rn <= size) AS sort_premium FROM (
  SELECT *, greatest(1, n // 5) AS size FROM (SELECT date, annualized_next, row_number() OVER (PARTITION BY date ORDER BY annualized, symbol) AS rn,
    count(*) OVER (PARTITION BY date) AS n FROM cross_section)) GROUP BY 1) p USING (date)""")


def dispersion(spark, sf):
    return D.daily_dispersion(cross_section(spark, sf))


@query("agg08_daily_dispersion", "SELECT date, n_eligible, n_funded, round(iqr, 12) AS iqr, round(std, 8) AS std, round(winsor_std, 8) AS winsor_std FROM dispersion")
def agg08(spark, sf):
    return round_to(round_to(dispersion(spark, sf).drop("sort_premium"), 12, "iqr"), 8, "std", "winsor_std")


@query("agg09_sort_premium", "SELECT date, round(sort_premium, 12) AS sort_premium FROM dispersion")
def agg09(spark, sf):
    return round_to(dispersion(spark, sf).select("date", "sort_premium"), 12, "sort_premium")


@query("agg18_coverage", """
SELECT round(avg(n_eligible), 6) AS mean_eligible, round(avg(n_funded), 6) AS mean_funded, round(avg(n_funded / n_eligible), 8) AS mean_coverage,
       round(min(n_funded / n_eligible), 8) AS min_coverage FROM dispersion""")
def agg18(spark, sf):
    out = D.coverage(dispersion(spark, sf))
    return round_to(round_to(out, 6, "mean_eligible", "mean_funded"), 8, "mean_coverage", "min_coverage")


cte("disp_series", """
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS idx, dt, ret FROM (
  SELECT 'iqr' AS series_id, date AS dt, iqr AS ret FROM dispersion UNION ALL
  SELECT 'sort_premium', date, sort_premium FROM dispersion WHERE sort_premium IS NOT NULL)""")


def disp_series(spark, sf):
    return stage(D.dispersion_series(dispersion(spark, sf), ["iqr", "sort_premium"]), "dispersion")


@query("win17_rolling_median", """
SELECT series_id, idx, dt, round(ret, 13) AS ret, CASE WHEN count(ret) OVER w >= 45 THEN round(quantile_cont(ret, 0.5) OVER w, 13) END AS rolling_median
FROM disp_series WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS 89 PRECEDING)""")
def win17(spark, sf):
    return round_to(D.rolling_median(D.dispersion_series(dispersion(spark, sf), ["iqr", "sort_premium"])), 13, "ret", "rolling_median")


score_ctes("disp", "disp_series")
cte("dispboot_source", "SELECT * FROM disp_series")
boot_ctes("dispboot", "disp", PATHS, SEED)
_CI = "round(quantile_cont(value, 0.025), 7) AS ci_low, round(quantile_cont(value, 0.975), 7) AS ci_high"


@query("scr08_mean_interval", f"""
SELECT b.series_id, n, round(mean, 8) AS mean, ci_low, ci_high, round(greatest(block, 2.0), 6) AS block,
       greatest(2, floor(n / greatest(block, 2.0)))::BIGINT AS effective_t
FROM disp_block b JOIN disp_stats s ON b.series_id = s.series_id
JOIN (SELECT series_id, {_CI} FROM dispboot_mean GROUP BY 1) c ON b.series_id = c.series_id""")
def scr08(spark, sf):
    out = B.mean_interval(disp_series(spark, sf), PATHS, SEED)
    return round_to(round_to(round_to(out, 8, "mean"), 7, "ci_low", "ci_high"), 6, "block")


cte("side_series", """
SELECT series_id || '#' || side AS series_id, row_number() OVER (PARTITION BY series_id, side ORDER BY dt) - 1 AS idx, ret, dt
FROM (SELECT *, CASE WHEN dt >= DATE '1999-01-01' THEN 'post_etf' ELSE 'pre_etf' END AS side FROM disp_series)""")
score_ctes("side", "side_series")
cte("sideboot_source", "SELECT * FROM side_series")
boot_ctes("sideboot", "side", PATHS, SEED + 10)


@query("scr09_regime_difference", f"""
SELECT *, round(p1 - p0, 8) AS difference FROM (
  SELECT split_part(series_id, '#', 1) AS series_id, max(mean) FILTER (ends_with(series_id, 'pre_etf')) AS p0, max(mean) FILTER (ends_with(series_id, 'post_etf')) AS p1,
         max(n) FILTER (ends_with(series_id, 'pre_etf')) AS n_pre, max(n) FILTER (ends_with(series_id, 'post_etf')) AS n_post FROM side_stats GROUP BY 1)
JOIN (SELECT series_id, {_CI} FROM (
  SELECT split_part(series_id, '#', 1) AS series_id, path,
         max(value) FILTER (ends_with(series_id, 'post_etf')) - max(value) FILTER (ends_with(series_id, 'pre_etf')) AS value FROM sideboot_mean GROUP BY 1, 2) GROUP BY 1) USING (series_id)
""".replace("SELECT *, round(p1 - p0, 8)", "SELECT series_id, n_pre, n_post, ci_low, ci_high, round(p0, 8) AS pre_mean, round(p1, 8) AS post_mean, round(p1 - p0, 8)"))
def scr09(spark, sf):
    series = disp_series(spark, sf).withColumn(
        "side", F.when(F.col("dt") >= F.lit("1999-01-01").cast("date"), "post_etf").otherwise("pre_etf")
    )
    series = series.withColumn("idx", F.row_number().over(over(["series_id", "side"], "dt")) - 1)
    out = B.difference_interval(series, "side", PATHS, SEED + 10)
    return round_to(round_to(out, 8, "pre_mean", "post_mean", "difference"), 7, "ci_low", "ci_high")


cte("disp_fit", """
SELECT series_id, regr_slope(ret, years) AS slope, regr_intercept(ret, years) AS intercept FROM (
  SELECT *, (dt - min(dt) OVER (PARTITION BY series_id)) / 365.0 AS years FROM disp_series) GROUP BY 1""")
cte("disp_fitted", """
SELECT d.series_id, idx, dt, ret, years, slope, intercept + slope * years AS fitted FROM (
  SELECT *, (dt - min(dt) OVER (PARTITION BY series_id)) / 365.0 AS years FROM disp_series) d JOIN disp_fit f ON d.series_id = f.series_id""")
cte("resid_series", "SELECT series_id, idx, dt, ret - fitted AS ret FROM disp_fitted")
score_ctes("resid", "resid_series")
cte("residboot_source", "SELECT * FROM resid_series")
boot_ctes("residboot", "resid", PATHS, SEED + 20)


@query("scr10_decay_interval", f"""
SELECT series_id, round(slope, 8) AS slope, ci_low, ci_high FROM disp_fit JOIN (
  SELECT series_id, {_CI} FROM (SELECT c.series_id, path, regr_slope(fitted + c.ret, years) AS value
    FROM residboot_cell c JOIN disp_fitted f ON c.series_id = f.series_id AND c.pos = f.idx GROUP BY 1, 2) GROUP BY 1) USING (series_id)""")
def scr10(spark, sf):
    out = B.trend_interval(disp_series(spark, sf), PATHS, SEED + 20)
    return round_to(round_to(out, 8, "slope"), 7, "ci_low", "ci_high")


@query("sig12_dispersion_decay", "SELECT series_id, round(slope, 8) AS slope, round(intercept, 8) AS intercept FROM disp_fit")
def sig12(spark, sf):
    return round_to(linear_trend(D.dispersion_series(dispersion(spark, sf), ["iqr", "sort_premium"])), 8, "slope", "intercept")


@query("set04_concatenated_sources", """
SELECT symbol, ts, round(rate, 10) AS rate, ingest FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY realized DESC, ingest) AS rn FROM funding) WHERE rn = 1""")
def set04(spark, sf):
    """Two per-venue sources concatenated by column name, then one dedup."""
    rows = funding(spark, sf)
    both = rows.filter("venue = 'V0'").unionByName(rows.filter("venue = 'V1'"))
    return round_to(P.settled_events(both).select("symbol", "ts", "rate", "ingest"), 10, "rate")
