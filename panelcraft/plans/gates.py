"""What the studies' verdicts rest on: recency, split stress, cost grids, trial families, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import regression as RG
from ..operators import scoring as S
from ..operators import signals as SG
from ..operators.portfolio import EQUITY_DAYS
from ..functions.windows import over
from .inputs import asset_series, bar_series, round_to, tilt_panel
from .portfolios import DIFFERENTIAL, cross_daily, sector_daily, week_tables
from .registry import cte, query
from .signals import portfolio_weeks
from .sqltext import max_sharpe, psr_of, score_ctes
from .stage import stage
from .universe import SLICES


def split_ctes(p: str, source: str) -> None:
    """Declare `<p>_fold`: the test rows of every split of a table (series_id, idx, ret), keyed `series_id/split_id`."""
    cte(f"{p}_fold", f"""
SELECT series_id || '/' || split_id AS series_id, row_number() OVER (PARTITION BY series_id, split_id ORDER BY idx) - 1 AS idx, ret
FROM (SELECT *, ntile(6) OVER (PARTITION BY series_id ORDER BY idx) - 1 AS grp, count(*) OVER (PARTITION BY series_id) AS size FROM {source}), combos
WHERE grp IN (g1, g2) AND size >= 6""")


# ---- recency --------------------------------------------------------------------------------------

cte("recent_series", "SELECT series_id || '/' || slice AS series_id, row_number() OVER (PARTITION BY series_id, slice ORDER BY dt) - 1 AS idx, ret FROM asset_series, (VALUES "
    + ", ".join(f"('{s['slice']}', DATE '{s['start']}')" for s in SLICES) + ") v(slice, start) WHERE dt >= start")
score_ctes("recent", "recent_series")


@query("prj09_recency_scores", """
SELECT split_part(series_id, '/', 1) AS series_id, split_part(series_id, '/', 2) AS slice, n, effective_t, round(psr0, 6) AS psr0 FROM recent_score WHERE n >= 126""")
def prj09_scores(spark, sf):
    out = G.recency_scores(stage(asset_series(spark, sf), "series"), SLICES)
    return round_to(out.select("series_id", "slice", "n", "effective_t", "psr0"), 6, "psr0")


# ---- static tilt ----------------------------------------------------------------------------------

EXPENSES = (0.0, 0.0005, 0.0011, 0.0020, 0.0035)
cte("tilt_gross", "SELECT portfolio AS series_id, row_number() OVER (PARTITION BY portfolio ORDER BY date) - 1 AS idx, ret - (mkt_rf + rf) AS ret FROM tilt_panel")
cte("tilt_costed", "SELECT series_id || '/' || c AS series_id, idx, ret - c / 252.0::DOUBLE AS ret FROM tilt_gross, (SELECT unnest([" + ", ".join(f"{e!r}::DOUBLE" for e in EXPENSES) + "]) AS c)")
score_ctes("tiltc", "tilt_costed")


def tilt_scores(spark, sf, expense: float):
    panel = RG.tilt_difference(tilt_panel(spark, sf), expense)
    idx = F.row_number().over(over(["portfolio"], "date")) - 1
    return S.score_series(stage(panel.select(F.col("portfolio").alias("series_id"), idx.alias("idx"), F.col("difference").alias("ret")), "tilts"))


@query("scr23_tilt_expense", """
SELECT split_part(series_id, '/', 1) AS portfolio, split_part(series_id, '/', 2)::DOUBLE AS cost_annual, n, round(sr, 6) AS sr, round(psr0, 6) AS psr0 FROM tiltc_score""")
def scr23_tilt(spark, sf):
    """Significance of the tilt at several differential expenses: one score per portfolio, moved for each expense."""
    out = G.cost_grid(tilt_scores(spark, sf, 0.0), EXPENSES, EQUITY_DAYS)
    return round_to(out.select(F.col("series_id").alias("portfolio"), "cost_annual", "n", "sr", "psr0"), 6, "sr", "psr0")


TRIALS, LEAST_TRIALS = (1, 4, 8, 16), 16
cte("tilt_net", f"SELECT series_id, idx, ret - {DIFFERENTIAL!r}::DOUBLE AS ret FROM tilt_gross")
score_ctes("tiltn", "tilt_net")
_FAMILY = psr_of(
    f"(SELECT *, {max_sharpe('v_sr', 'trials')} AS s FROM (SELECT m.*, v_sr, nv, trials::DOUBLE AS trials FROM tiltn_score m, (SELECT var_samp(sr) AS v_sr, count(sr) AS nv FROM tiltn_score), (VALUES "
    + ", ".join(f"({t})" for t in TRIALS) + ") v(trials) WHERE series_id = 'promo'))",
    "series_id, trials, v_sr, nv", "sr", "s", "effective_t", "skew", "kurt", "p")


@query("scr22_tilt_family", f"""
SELECT series_id, trials::INTEGER AS trials, nv AS n_variants, round(v_sr, 10) AS v_sr, round(p, 6) AS dsr, coalesce(trials = {LEAST_TRIALS} AND p >= 0.95, false) AS passes FROM ({_FAMILY})""")
def scr22_tilt(spark, sf):
    """One tilt portfolio against the family of all of them."""
    scores = stage(tilt_scores(spark, sf, DIFFERENTIAL), "scores")
    out = G.family_ladder(scores, F.col("series_id") == "promo", TRIALS, LEAST_TRIALS)
    return round_to(round_to(out.select("series_id", "trials", "n_variants", "v_sr", "dsr", "passes"), 10, "v_sr"), 6, "dsr")


# ---- cross-sectional study ------------------------------------------------------------------------

RETAIL, ACADEMIC = "long_only_top|taker|delisting_loss", "long_short_top_minus_bottom|taker|delisting_loss"
cte("gate_series", f"SELECT * FROM bp_series WHERE series_id IN ('{RETAIL}', '{ACADEMIC}')")
split_ctes("gate", "gate_series")
score_ctes("gatef", "gate_fold")
cte("gate_trials", "SELECT count(sr)::DOUBLE AS trials, coalesce(var_samp(sr), 0) AS v_sr FROM bp_score")


def _deflated(source: str) -> str:
    return psr_of(f"(SELECT m.*, v_sr, trials, {max_sharpe('v_sr', 'trials')} AS s FROM {source} m, gate_trials)", "series_id, n, effective_t, sr, v_sr, trials", "sr", "s", "effective_t", "skew", "kurt", "p")


cte("gate_whole", f"SELECT * FROM ({_deflated('bp_score')}) WHERE series_id IN ('{RETAIL}', '{ACADEMIC}')")
cte("gate_splits", f"""
SELECT split_part(series_id, '/', 1) AS series_id, min(p) AS lo, median(p) AS mid, max(p) AS hi, count(p) AS n_scored FROM ({_deflated('gatef_score')}) GROUP BY 1""")


def cross_sectional_gate(spark, sf):
    weeks = stage(portfolio_weeks(spark, sf), "weeks")
    series = weeks.select(F.concat_ws("|", *SG.VARIANT).alias("series_id"), (F.col("week_no") - 1).alias("idx"), F.col("net_return").alias("ret"))
    family = stage(S.score_series(series), "family")
    return G.deflated_gate(series.filter(F.col("series_id").isin(RETAIL, ACADEMIC)), family)


@query("scr26_cross_sectional_gate", """
SELECT series_id, n, effective_t, round(sr, 6) AS sr, trials::BIGINT AS n_trials, round(v_sr, 9) AS v_sr, round(p, 6) AS full_dsr, round(lo, 6) AS split_min, round(mid, 6) AS split_median, round(hi, 6) AS split_max,
       n_scored, coalesce(lo >= 0.95, false) AS passes FROM gate_whole JOIN gate_splits USING (series_id)""")
def scr26_cross(spark, sf):
    out = cross_sectional_gate(spark, sf).select("series_id", "n", "effective_t", "sr", "n_trials", "v_sr", "full_dsr", "split_min", "split_median", "split_max", "n_scored", "passes")
    return round_to(round_to(out, 9, "v_sr"), 6, "sr", "full_dsr", "split_min", "split_median", "split_max")


@query("scr26_cross_sectional_verdict", f"""
SELECT r AS deployable_passes, a AS benchmark_passes, CASE WHEN r THEN 'not_killed' WHEN a THEN 'non_viable_benchmark_only' ELSE 'non_viable' END AS verdict FROM (
  SELECT coalesce(bool_or(lo >= 0.95) FILTER (series_id = '{RETAIL}'), false) AS r, coalesce(bool_or(lo >= 0.95) FILTER (series_id = '{ACADEMIC}'), false) AS a FROM gate_splits)""")
def scr26_cross_verdict(spark, sf):
    return G.two_portfolio_verdict(cross_sectional_gate(spark, sf), RETAIL, ACADEMIC)


# ---- weekly trend ---------------------------------------------------------------------------------

split_ctes("wk", "week_series")
score_ctes("wkf", "wk_fold")
cte("wk_stress", """
SELECT split_part(series_id, '/', 1) || '/' || split_part(series_id, '/', 2) AS series_id, min(psr0) AS lo, median(psr0) AS mid, count(psr0) AS n_scored, min(n) AS min_test FROM wkf_score GROUP BY 1""")


@query("scr26_trend_gate", """
SELECT n, effective_t, round(psr0, 6) AS psr0, round(lo, 6) AS split_min, round(mid, 6) AS split_median, coalesce(n_scored, 0) AS n_scored, min_test,
       CASE WHEN n < 6 THEN 'too_short' ELSE 'ok' END AS split_status, round(m, 7) AS max_target,
       CASE WHEN NOT (coalesce(psr0 >= 0.95, false) AND m <= 1 + 1e-12) THEN 'non_viable' WHEN coalesce(lo < 0.95, false) THEN 'regime_dependent' ELSE 'not_killed' END AS verdict
FROM weekt_score LEFT JOIN wk_stress USING (series_id), (SELECT max(target_gross) AS m FROM week_result)""")
def scr26_trend(spark, sf):
    """The weekly trend verdict with its stress over the combinatorial splits."""
    weeks = stage(week_tables(spark, sf)[2].withColumn("series_id", F.lit("trend")), "weeks")
    series = weeks.select("series_id", (F.row_number().over(over(["series_id"], "signal_date")) - 1).alias("idx"), F.col("net_return").alias("ret"))
    stress = G.split_stress(series).select("series_id", F.col("min").alias("split_min"), F.col("median").alias("split_median"), "n_scored", "min_test", "split_status")
    facts = weeks.groupBy("series_id").agg(F.max("target_gross").alias("max_target"))
    scores = S.score_series(series).join(stress, "series_id").join(facts, "series_id")
    out = S.verdict(scores, {"psr0": 0.95, "max_target": 1.0}, ["split_min"])
    out = out.select("n", "effective_t", "psr0", "split_min", "split_median", "n_scored", "min_test", "split_status", "max_target", "verdict")
    return round_to(round_to(out, 6, "psr0", "split_min", "split_median"), 7, "max_target")


# ---- overlap of two studies -----------------------------------------------------------------------

cte("bets", """
SELECT s.date, s.net_ret - a.net_ret AS ra, s.invested_target AS aa, c.excess_ret AS rb, c.invested_target AS ab
FROM (SELECT * FROM sector_daily WHERE variant = 'ma10') s JOIN (SELECT date, net_ret FROM sector_daily WHERE variant = 'always') a USING (date)
JOIN (SELECT date, excess_ret, invested_target FROM cross_daily WHERE variant = 'equity_alone') c USING (date)""")


@query("scr29_bet_overlap", """
SELECT n AS n_aligned, round(CASE WHEN n >= 126 AND va > 0 AND vb > 0 THEN rc ELSE 0 END, 6) AS return_corr, round(CASE WHEN n >= 126 AND wa > 0 AND wb > 0 THEN ac ELSE 0 END, 6) AS active_corr,
       round(CASE WHEN n >= 126 AND s > 0 THEN m / s * sqrt(252) ELSE 0 END, 6) AS combo_sharpe FROM (
  SELECT count(*) AS n, corr(ra, rb) AS rc, corr(aa, ab) AS ac, avg((ra + rb) / 2) AS m, stddev_samp((ra + rb) / 2) AS s, var_pop(ra) AS va, var_pop(rb) AS vb, var_pop(aa) AS wa, var_pop(ab) AS wb FROM bets)""")
def scr29_overlap(spark, sf):
    """Timing of the sector rotation against the equity sleeve of the cross-asset rule, in returns and in invested shares."""
    sectors = stage(sector_daily(spark, sf).filter(F.col("variant").isin("ma10", "always")).select("variant", "date", "net_ret", "invested_target"), "sectors")
    base = sectors.filter("variant = 'always'").select("date", F.col("net_ret").alias("_base"))
    timing = sectors.filter("variant = 'ma10'").join(base, "date").select("date", (F.col("net_ret") - F.col("_base")).alias("ret"), F.col("invested_target").alias("active"))
    sleeve = cross_daily(spark, sf).filter("variant = 'equity_alone'").select("date", F.col("excess_ret").alias("ret"), F.col("invested_target").alias("active"))
    return round_to(G.overlap(timing, sleeve, EQUITY_DAYS), 6, "return_corr", "active_corr", "combo_sharpe")


# ---- splits of short series -----------------------------------------------------------------------

cte("wide_series", "SELECT series_id || '/' || year(dt) || '-' || month(dt) AS series_id, row_number() OVER (PARTITION BY series_id, date_trunc('month', dt) ORDER BY dt) - 1 AS idx, ret FROM bar_series")
split_ctes("wide", "wide_series")
score_ctes("widef", "wide_fold")


@query("scr21_monthly_split_stress", """
SELECT t.series_id, CASE WHEN n < 6 THEN 'too_short' ELSE 'ok' END AS split_status, coalesce(n_scored, 0) AS n_scored, min_test, round(lo, 6) AS min, round(mid, 6) AS median, round(hi, 6) AS max
FROM (SELECT series_id, count(*) AS n FROM wide_series GROUP BY 1) t LEFT JOIN (
  SELECT split_part(series_id, '/', 1) || '/' || split_part(series_id, '/', 2) AS series_id, count(psr0) AS n_scored, min(n) AS min_test, min(psr0) AS lo, median(psr0) AS mid, max(psr0) AS hi
  FROM widef_score GROUP BY 1) USING (series_id)""")
def scr21_monthly(spark, sf):
    """Split stress of every symbol's months, many of which have fewer days than there are groups."""
    rows = bar_series(spark, sf).withColumn("series_id", F.concat(F.col("series_id"), F.lit("/"), F.year("dt").cast("string"), F.lit("-"), F.month("dt").cast("string")))
    rows = rows.withColumn("idx", F.row_number().over(over(["series_id"], "dt")) - 1)
    out = G.split_stress(stage(rows.select("series_id", "idx", "ret"), "months"))
    return round_to(out.select("series_id", "split_status", "n_scored", "min_test", "min", "median", "max"), 6, "min", "median", "max")
