"""Indicator, cross-sectional signal, bucket portfolio, trial-table and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rolling
from ..operators import costs
from ..operators import features as FT
from ..operators import fingerprint as FP
from ..operators import panel as P
from ..operators import returns as R
from ..operators import scoring as S
from ..operators import signals as SG
from ..operators import trials as TR
from ..functions.ema import span, wilder, with_ema
from .inputs import asset_series, bar_series, bars, round_to
from .registry import cte, query
from .sqltext import score_ctes
from .stage import scratch_path, stage

WINDOW = 52

# ---- indicators -----------------------------------------------------------------------------------


@query("win01_rolling_windows", """
SELECT symbol, date, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 7) END AS mean, CASE WHEN count(*) OVER w = 20 THEN round(min(low) OVER w, 7) END AS low,
       CASE WHEN count(*) OVER w = 20 THEN round(max(high) OVER w, 7) END AS high, CASE WHEN count(*) OVER w = 20 THEN round(sum(dollar_volume) OVER w, 3) END AS volume,
       CASE WHEN count(*) OVER w = 20 THEN round(stddev_pop(close) OVER w, 7) END AS dev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""")
def win01(spark, sf):
    def roll(c, op):
        return rolling(c, op, ["symbol"], "date", 20)

    return bars(spark, sf).select(
        "symbol", "date", F.round(roll("close", "mean"), 7).alias("mean"), F.round(roll("low", "min"), 7).alias("low"),
        F.round(roll("high", "max"), 7).alias("high"), F.round(roll("dollar_volume", "sum"), 3).alias("volume"), F.round(roll("close", "std"), 7).alias("dev"),
    )


_W = "(PARTITION BY symbol ORDER BY date ROWS {} PRECEDING)"


def _full(expr: str, n: int, counted: str = "close") -> str:
    w = _W.format(n - 1)
    return f"CASE WHEN count({counted}) OVER {w} = {n} THEN {expr.format(w=w)} END"


_SMA = [f"{_full('avg(close) OVER {w}', n)} / close AS sma_{n}d" for n in FT.SMA_LENGTHS]
_VSMA = [f"{_full('avg(dollar_volume) OVER {w}', n)} / dollar_volume AS volsma_{n}d" for n in FT.SMA_LENGTHS]
cte("sma_table", f"SELECT symbol, date, {', '.join(_SMA + _VSMA)} FROM bars")
_SMA_COLS = [f"sma_{n}d" for n in FT.SMA_LENGTHS] + [f"volsma_{n}d" for n in FT.SMA_LENGTHS]


@query("win02_sma_ratios", f"SELECT symbol, date, {', '.join(f'round({c}, 7) AS {c}' for c in _SMA_COLS)} FROM sma_table")
def win02(spark, sf):
    return round_to(FT.sma_ratios(bars(spark, sf)).select("symbol", "date", *_SMA_COLS), 7, *_SMA_COLS)


cte("bar_no", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS move FROM bars")
# One recursion carries every average: value rows step by bar number, and an average that is not seeded yet starts at its input.
_A = {"f": 2 / 13, "s": 2 / 27, "vf": 2 / 13, "vs": 2 / 27, "up": 1 / 14, "dn": 1 / 14}
_IN = {"f": "b.close", "s": "b.close", "vf": "b.dollar_volume", "vs": "b.dollar_volume", "up": "greatest(b.move, 0)", "dn": "greatest(-b.move, 0)"}


def _step(k: str) -> str:
    a = f"({_A[k]!r}::DOUBLE)"
    return f"CASE WHEN e.{k} IS NULL THEN {_IN[k]} ELSE (1 - {a}) * e.{k} + {a} * {_IN[k]} END"


def _line(name: str, fast: str, slow: str) -> str:
    x = f"((({_step(fast)}) - ({_step(slow)})) / ({_step(fast)}))"
    return f"CASE WHEN b.rn < 26 THEN NULL WHEN e.{name} IS NULL THEN {x} ELSE 0.8::DOUBLE * e.{name} + 0.2::DOUBLE * {x} END"


cte("ema_table", f"""
SELECT symbol, rn, close AS f, close AS s, dollar_volume AS vf, dollar_volume AS vs, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, NULL::DOUBLE AS pl, NULL::DOUBLE AS vl FROM bar_no WHERE rn = 1
UNION ALL SELECT b.symbol, b.rn, {', '.join(_step(k) for k in _A)}, {_line('pl', 'f', 's')}, {_line('vl', 'vf', 'vs')}
FROM ema_table e JOIN bar_no b ON b.symbol = e.symbol AND b.rn = e.rn + 1""", recursive=True)
cte("osc", """
SELECT symbol, date, CASE WHEN rn >= 26 THEN (f - s) / f END AS macd, CASE WHEN rn >= 26 THEN (vf - vs) / vf END AS volmacd,
       CASE WHEN rn >= 34 THEN (f - s) / f - pl END AS macd_diff_signal, CASE WHEN rn >= 34 THEN (vf - vs) / vf - vl END AS volmacd_diff_signal,
       CASE WHEN rn >= 15 THEN CASE WHEN dn = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1 + up / dn) END END AS rsi, rn, f, s, up, close, dollar_volume
FROM ema_table JOIN bar_no USING (symbol, rn)""")


@query("win03_recursive_averages", """
SELECT symbol, date, CASE WHEN rn >= 12 THEN round(f, 7) END AS ema12, CASE WHEN rn >= 26 THEN round(s, 7) END AS ema26, CASE WHEN rn >= 15 THEN round(up, 7) END AS gain14 FROM osc""")
def win03(spark, sf):
    rows = bars(spark, sf)
    move = F.col("close") - F.lag("close").over(FT.over(["symbol"], "date"))
    rows = rows.withColumn("gain", F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))))
    out = with_ema(rows, {"ema12": span("close", 12), "ema26": span("close", 26), "gain14": wilder("gain", 14)}, ["symbol"], "date")
    return round_to(out.select("symbol", "date", "ema12", "ema26", "gain14"), 7, "ema12", "ema26", "gain14")


_OSC = ("macd", "macd_diff_signal", "volmacd", "volmacd_diff_signal")


@query("win04_oscillators", f"SELECT symbol, date, {', '.join(f'round({c}, 8) AS {c}' for c in _OSC)} FROM osc")
def win04(spark, sf):
    return round_to(FT.oscillators(bars(spark, sf)).select("symbol", "date", *_OSC), 8, *_OSC)


cte("range_base", f"""
SELECT o.symbol, o.date, o.rsi, b.close, b.high, b.low, b.dollar_volume, (b.high + b.low + b.close) / 3.0 AS tp,
       CASE WHEN b.high > b.low THEN (2 * b.close - b.low - b.high) / (b.high - b.low) ELSE 0 END * b.dollar_volume AS flow FROM osc o JOIN bars b ON o.symbol = b.symbol AND o.date = b.date""")
cte("range_table", f"""
SELECT *, {_full('avg(stochK) OVER {w}', 3, 'stochK')} AS stochD, CASE WHEN len(seen) = 20 THEN list_avg(list_transform(seen, lambda x: abs(x - mid))) END AS spread FROM (
  SELECT *, {_full('CASE WHEN max(rsi) OVER {w} > min(rsi) OVER {w} THEN (rsi - min(rsi) OVER {w}) / (max(rsi) OVER {w} - min(rsi) OVER {w}) END', 14, 'rsi')} AS stochRSI,
         {_full('CASE WHEN max(high) OVER {w} > min(low) OVER {w} THEN 100 * (close - min(low) OVER {w}) / (max(high) OVER {w} - min(low) OVER {w}) END', 14)} AS stochK,
         {_full('avg(tp) OVER {w}', 20)} AS mid, list(tp) OVER {_W.format(19)} AS seen, {_full('sum(flow) OVER {w} / sum(dollar_volume) OVER {w}', 20)} AS chaikin,
         {_full('avg(close) OVER {w}', 20)} AS sma, {_full('stddev_pop(close) OVER {w}', 20)} AS dev FROM range_base)""")
_RANGE = ("rsi", "stochRSI", "stochK", "stochD", "cci", "chaikin", "boll_mid", "boll_high", "boll_low", "boll_width")
cte("range_out", """
SELECT symbol, date, rsi, stochRSI, stochK, stochD, CASE WHEN spread > 0 THEN (tp - mid) / (0.015 * spread) END AS cci, chaikin, sma / close AS boll_mid,
       (sma + 2 * dev) / close AS boll_high, (sma - 2 * dev) / close AS boll_low, ((sma + 2 * dev) / close - (sma - 2 * dev) / close) / (sma / close) AS boll_width FROM range_table""")


@query("win05_range_indicators", f"SELECT symbol, date, {', '.join(f'round({c}, 6) AS {c}' for c in _RANGE)} FROM range_out")
def win05(spark, sf):
    out = FT.ranges(FT.relative_strength(bars(spark, sf))).select("symbol", "date", *_RANGE)
    return round_to(out, 6, *_RANGE)


cte("feature_table", f"SELECT symbol, date, {', '.join(FT.SIGNALS)} FROM range_out JOIN osc USING (symbol, date) JOIN sma_table USING (symbol, date)".replace(
    ", rsi, ", ", range_out.rsi, ", 1).replace("SELECT symbol, date, rsi,", "SELECT symbol, date, range_out.rsi AS rsi,"))
_ALL = ", ".join(f"round({c}, 6) AS {c}" for c in FT.SIGNALS)


@query("win06_daily_features", f"SELECT symbol, date, {_ALL} FROM feature_table")
def win06(spark, sf):
    return round_to(FT.daily_features(bars(spark, sf)), 6, *FT.SIGNALS)


cte("feature_weeks", "SELECT * EXCLUDE (rn) FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, row_number() OVER (PARTITION BY symbol, date_trunc('week', date) ORDER BY date DESC) AS rn FROM feature_table) WHERE rn = 1")


@query("agg05_weekly_features", f"SELECT week_end, symbol, {_ALL} FROM feature_weeks")
def agg05(spark, sf):
    return round_to(FT.weekly_features(FT.daily_features(bars(spark, sf))), 6, *FT.SIGNALS)


# ---- cross-sectional signals ----------------------------------------------------------------------

cte("sig_frame", "SELECT u.week_end, u.symbol, u.forward_return, f.* EXCLUDE (symbol, date, week_end) FROM universe u LEFT JOIN feature_weeks f ON f.symbol = u.symbol AND f.week_end = u.week_end WHERE u.eligible")
cte("sig_long", f"SELECT week_end, symbol, forward_return, signal, z FROM sig_frame UNPIVOT INCLUDE NULLS (z FOR signal IN ({', '.join(FT.SIGNALS)}))")
cte("sig_ranked", """
SELECT week_end, symbol, forward_return, signal, CASE WHEN z IS NOT NULL AND n >= 2 THEN (rk + (ties - 1) / 2.0 - 1) / (n - 1) - 0.5 END AS z FROM (
  SELECT *, rank() OVER (PARTITION BY week_end, signal ORDER BY z NULLS LAST) AS rk, count(*) OVER (PARTITION BY week_end, signal, z) AS ties, count(z) OVER (PARTITION BY week_end, signal) AS n FROM sig_long)""")
cte("sig_fm", """
SELECT week_end, signal, r - beta * m AS alpha, beta FROM (SELECT week_end, signal, avg(forward_return) AS r, avg(z) AS m, CASE WHEN count(*) >= 2 AND var_pop(z) > 0 THEN covar_pop(z, forward_return) / var_pop(z) END AS beta
  FROM sig_ranked WHERE z IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1, 2)""")
cte("sig_smooth", f"""
SELECT week_end, signal, CASE WHEN count(alpha) OVER w = {WINDOW} THEN avg(alpha) OVER w END AS alpha_bar, CASE WHEN count(beta) OVER w = {WINDOW} THEN avg(beta) OVER w END AS beta_bar
FROM sig_fm WINDOW w AS (PARTITION BY signal ORDER BY week_end ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)""")
cte("sig_forecast", "SELECT r.week_end, symbol, forward_return, r.signal, alpha_bar + beta_bar * z AS rhat FROM sig_ranked r LEFT JOIN sig_smooth s ON s.week_end = r.week_end AND s.signal = r.signal")


def frame(spark, sf):
    base = stage(bars(spark, sf), "bars")
    flagged = P.liquid_universe(P.weekly_panel(base), top_n=10)
    return SG.signal_frame(FT.weekly_features(FT.daily_features(base)), flagged)


def ranked(spark, sf):
    return SG.rank_map(SG.long_signals(frame(spark, sf)))


def long_forecasts(spark, sf):
    rows = stage(ranked(spark, sf), "ranked")
    return SG.forecasts(rows, SG.smooth_coefficients(SG.weekly_regressions(rows), WINDOW))


@query("jn05_signal_frame", f"SELECT week_end, symbol, round(forward_return, 7) AS forward_return, {_ALL} FROM sig_frame")
def jn05(spark, sf):
    return round_to(round_to(frame(spark, sf), 6, *FT.SIGNALS), 7, "forward_return")


@query("sig01_long_signals", "SELECT week_end, symbol, round(forward_return, 7) AS forward_return, signal, round(z, 6) AS z FROM sig_long WHERE z IS NOT NULL AND forward_return IS NOT NULL")
def sig01(spark, sf):
    out = SG.long_signals(frame(spark, sf)).filter("z IS NOT NULL AND forward_return IS NOT NULL")
    return round_to(round_to(out, 6, "z"), 7, "forward_return")


@query("win10_rank_map", "SELECT week_end, symbol, signal, round(z, 9) AS z FROM sig_ranked")
def win10(spark, sf):
    return round_to(ranked(spark, sf).select("week_end", "symbol", "signal", "z"), 9, "z")


@query("sig02_weekly_regressions", "SELECT week_end, signal, round(alpha, 8) AS alpha, round(beta, 8) AS beta FROM sig_fm")
def sig02(spark, sf):
    return round_to(SG.weekly_regressions(ranked(spark, sf)), 8, "alpha", "beta")


@query("win12_smoothed_coefficients", "SELECT week_end, signal, round(alpha_bar, 8) AS alpha_bar, round(beta_bar, 8) AS beta_bar FROM sig_smooth")
def win12(spark, sf):
    return round_to(SG.smooth_coefficients(SG.weekly_regressions(ranked(spark, sf)), WINDOW), 8, "alpha_bar", "beta_bar")


@query("sig03_forecasts", "SELECT week_end, symbol, signal, round(rhat, 8) AS rhat FROM sig_forecast")
def sig03(spark, sf):
    return round_to(long_forecasts(spark, sf).select("week_end", "symbol", "signal", "rhat"), 8, "rhat")


@query("sig03_wide_forecasts", f"""
SELECT week_end, symbol, round(forward_return, 7) AS forward_return, {', '.join(f"round(max(rhat) FILTER (signal = '{c}'), 8) AS {c}" for c in FT.SIGNALS)} FROM sig_forecast GROUP BY week_end, symbol, sig_forecast.forward_return""")
def sig03_wide(spark, sf):
    return round_to(round_to(SG.widen(long_forecasts(spark, sf)), 8, *FT.SIGNALS), 7, "forward_return")


cte("sig_case", f"""
SELECT week_end, symbol, forward_return, count(rhat) = {len(FT.SIGNALS)} AND forward_return IS NOT NULL AS complete FROM sig_forecast GROUP BY 1, 2, 3""")


@query("sig04_training_pool", f"""
SELECT week_end, pool_rows, pool_weeks FROM (SELECT week_end, sum(n) OVER w AS pool_rows, count(*) OVER w AS pool_weeks FROM (
  SELECT week_end, count(*) FILTER (complete) AS n FROM sig_case GROUP BY 1) WINDOW w AS (ORDER BY week_end ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
WHERE pool_weeks = {WINDOW} AND pool_rows >= 3""".replace("SELECT week_end, pool_rows, pool_weeks FROM", "SELECT week_end, pool_rows::DOUBLE AS pool_rows FROM", 1))
def sig04(spark, sf):
    """Complete rows in each week's training pool, read off the pooled product sums."""
    pooled = SG.pooled_moments(SG.complete_cases(long_forecasts(spark, sf)), WINDOW)
    return pooled.select("week_end", F.col("sums")[0].alias("pool_rows"))


_ORDERED = "list(rhat ORDER BY list_position([" + ", ".join(f"'{s}'" for s in FT.SIGNALS) + "], signal))"


@query("sig07_weekly_moments", f"""
SELECT week_end, pos - 1 AS pos, round(sum(v), 9) AS value FROM (
  SELECT week_end, unnest(range(1, 466)) AS pos, unnest(flatten([[x[i] * x[j] for j in range(i, 31)] for i in range(1, 31)])) AS v FROM (
    SELECT week_end, symbol, list_concat([1.0::DOUBLE], {_ORDERED}, [any_value(forward_return)]) AS x FROM sig_forecast GROUP BY 1, 2 HAVING count(rhat) = 28 AND count(forward_return) > 0))
GROUP BY 1, 2""")
def sig07(spark, sf):
    out = SG.weekly_moments(SG.complete_cases(long_forecasts(spark, sf)))
    return round_to(out.select("week_end", F.col("pos").cast("bigint").alias("pos"), "value"), 9, "value")


@query("sig06_selected_signals")
def sig06(spark, sf):
    """Iterative solver, no SQL twin: the tests compare it with a dense solver and planted predictors."""
    return SG.select_signals(SG.pooled_moments(SG.complete_cases(long_forecasts(spark, sf)), WINDOW))


@query("sig06_certificates", f"""
SELECT week_end, pool_rows::DOUBLE AS pool_rows, 50 AS n_points, true AS optimal, true AS best FROM (SELECT week_end, sum(n) OVER w AS pool_rows, count(*) OVER w AS pool_weeks FROM (
  SELECT week_end, count(*) FILTER (complete) AS n FROM sig_case GROUP BY 1) WINDOW w AS (ORDER BY week_end ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
WHERE pool_weeks = {WINDOW} AND pool_rows >= 3""")
def sig06_certificates(spark, sf):
    """Every week's selection proven optimal from the product sums alone; a week that fails shows false."""
    pooled = SG.pooled_moments(SG.complete_cases(long_forecasts(spark, sf)), WINDOW)
    return SG.certify_paths(stage(SG.solve_paths(pooled), "paths"))


@query("sig05_combined_forecast", """
SELECT week_end, symbol, round(avg(rhat), 8) AS score FROM sig_forecast GROUP BY 1, 2 HAVING count(rhat) > 0""")
def sig05(spark, sf):
    return round_to(scored(spark, sf).select("week_end", "symbol", "score"), 8, "score")


@query("sig08_cross_sectional_forecasts")
def sig08(spark, sf):
    """The whole chain from bars to bucketed scores, with the iterative selection inside."""
    return SG.cross_sectional_forecasts(stage(frame(spark, sf), "frame"), WINDOW)


# Buckets on the mean of all forecasts, so that everything after the selection has a SQL twin.
cte("scored", "SELECT week_end, symbol, avg(rhat) AS score, forward_return FROM sig_forecast GROUP BY 1, 2, 4 HAVING count(rhat) > 0")
cte("bucketed", """
SELECT week_end, symbol, score, forward_return, least(4, (rn - 1) * 5 // n)::INTEGER AS bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY round(score, 10), symbol) AS rn, count(*) OVER (PARTITION BY week_end) AS n FROM scored) WHERE n >= 5""")


def scored(spark, sf):
    return SG.combine(long_forecasts(spark, sf))


def bucketed(spark, sf):
    return SG.assign_buckets(scored(spark, sf).withColumn("score", F.round("score", 10)))


@query("win11_buckets", "SELECT week_end, symbol, bucket FROM bucketed")
def win11(spark, sf):
    return bucketed(spark, sf).select("week_end", "symbol", "bucket")


cte("weekly_ic", """
SELECT week_end, count(*) AS n, corr(a, b) AS ic FROM (
  SELECT week_end, rank() OVER (PARTITION BY week_end ORDER BY s) + (count(*) OVER (PARTITION BY week_end, s) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY week_end ORDER BY forward_return) + (count(*) OVER (PARTITION BY week_end, forward_return) - 1) / 2.0 AS b
  FROM (SELECT *, round(score, 10) AS s FROM scored WHERE forward_return IS NOT NULL)) GROUP BY 1 HAVING count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0""")


@query("sig09_weekly_rank_ic", "SELECT week_end, n, round(ic, 8) AS ic FROM weekly_ic")
def sig09(spark, sf):
    return round_to(SG.rank_ic(scored(spark, sf).withColumn("score", F.round("score", 10))), 8, "ic")


_IC = "round(avg(ic), 8) AS mean_ic, count(*) AS n_weeks, round(avg((ic > 0)::INT), 8) AS frac_positive, round(CASE WHEN stddev_pop(ic) > 0 THEN avg(ic) / (stddev_pop(ic) / sqrt(count(*))) ELSE 0 END, 7) AS ic_t_stat"


@query("sig09_ic_by_year", f"SELECT year(week_end)::INTEGER AS year, {_IC} FROM weekly_ic GROUP BY 1 UNION ALL SELECT 0, {_IC} FROM weekly_ic")
def sig09_years(spark, sf):
    """Summary per calendar year, and over all weeks as year 0."""
    weekly = stage(SG.rank_ic(scored(spark, sf).withColumn("score", F.round("score", 10))), "ic")
    years = F.explode(F.array(F.year("week_end"), F.lit(0)))
    out = SG.ic_summary(weekly.withColumn("year", years), ["year"])
    return round_to(round_to(out, 8, "mean_ic", "frac_positive"), 7, "ic_t_stat")


@query("sig10_bucket_returns", """
SELECT bucket, round(m, 8) AS mean_forward, round(m - first(m) OVER (ORDER BY bucket), 8) AS over_lowest FROM (
  SELECT b::INTEGER AS bucket, coalesce(avg(forward_return), 0) AS m FROM (SELECT unnest(range(0, 5)) AS b) LEFT JOIN bucketed ON bucket = b GROUP BY 1)""")
def sig10(spark, sf):
    return round_to(SG.bucket_returns(bucketed(spark, sf)), 8, "mean_forward", "over_lowest")


_TAKER, _MAKER = costs.leg_cost(26.0, costs.SPOT_HALF_SPREAD_BPS), costs.leg_cost(16.0, costs.SPOT_HALF_SPREAD_BPS)
VARIANTS = SG.portfolio_variants(_TAKER, _MAKER)
cte("bp_rows", f"""
SELECT b.*, portfolio, execution, missing_policy, cost, bucket = 4 AS top FROM (SELECT * REPLACE (CASE WHEN dayofyear(week_end) % 9 = 0 AND bucket IN (0, 4) AND ends_with(symbol, '2') THEN NULL ELSE forward_return END AS forward_return) FROM bucketed) b,
  (VALUES ('long_only_top'), ('long_short_top_minus_bottom')) p(portfolio), (VALUES ('taker', {_TAKER!r}::DOUBLE), ('maker', {_MAKER!r}::DOUBLE)) e(execution, cost), (VALUES ('delisting_loss'), ('drop_and_renormalize')) m(missing_policy)
WHERE (bucket = 4 OR (portfolio = 'long_short_top_minus_bottom' AND bucket = 0)) AND NOT (forward_return IS NULL AND missing_policy = 'drop_and_renormalize')""")
cte("bp_held", """
SELECT *, CASE WHEN portfolio = 'long_only_top' THEN 1.0 / nl WHEN top THEN 0.5 / nl ELSE -0.5 / ns END AS weight, dense_rank() OVER (PARTITION BY portfolio, execution, missing_policy ORDER BY week_end) AS no FROM (
  SELECT *, count(*) FILTER (top) OVER w AS nl, count(*) FILTER (NOT top) OVER w AS ns, count(forward_return) OVER w AS known FROM bp_rows WINDOW w AS (PARTITION BY portfolio, execution, missing_policy, week_end))
WHERE known > 0 AND nl > 0 AND (portfolio = 'long_only_top' OR ns > 0)""")
cte("bp_turnover", """
SELECT portfolio, execution, missing_policy, no, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover
FROM (SELECT portfolio, execution, missing_policy, no, symbol, weight FROM bp_held) a
FULL JOIN (SELECT portfolio, execution, missing_policy, no + 1 AS no, symbol, weight FROM bp_held WHERE forward_return IS NOT NULL) b USING (portfolio, execution, missing_policy, no, symbol) GROUP BY 1, 2, 3, 4""")
cte("bp_weeks", """
SELECT h.portfolio, h.execution, h.missing_policy, week_end, h.no AS week_no, sum(weight * coalesce(forward_return, -1)) AS gross_return, count(*) FILTER (top) AS n_long, count(*) FILTER (NOT top) AS n_short,
       count(*) FILTER (forward_return IS NULL) AS n_missing, any_value(turnover) AS turnover, any_value(turnover) * any_value(cost) AS cost
FROM bp_held h JOIN bp_turnover t ON t.portfolio = h.portfolio AND t.execution = h.execution AND t.missing_policy = h.missing_policy AND t.no = h.no GROUP BY 1, 2, 3, 4, 5""")


def with_missing(rows):
    """Blank some forward returns of the outer buckets, so that both missing-return policies have work."""
    gone = (F.dayofyear("week_end") % 9 == 0) & F.col("bucket").isin(0, 4) & F.col("symbol").endswith("2")
    return rows.withColumn("forward_return", F.when(~gone, F.col("forward_return")))


def portfolio_weeks(spark, sf):
    return SG.bucket_portfolios(stage(with_missing(bucketed(spark, sf)), "buckets"), VARIANTS)


_BP = ("gross_return", "turnover", "cost")


@query("pnl10_bucket_portfolios", f"""
SELECT portfolio, execution, missing_policy, week_end, week_no, n_long, n_short, n_missing, {', '.join(f'round({c}, 8) AS {c}' for c in _BP)}, round(gross_return - cost, 8) AS net_return FROM bp_weeks""")
def pnl10(spark, sf):
    return round_to(portfolio_weeks(spark, sf), 8, *_BP, "net_return")


@query("set01_holding_turnover", "SELECT portfolio, execution, missing_policy, no AS week_no, round(turnover, 8) AS turnover FROM bp_turnover WHERE no <= (SELECT max(no) FROM bp_held h WHERE h.portfolio = bp_turnover.portfolio AND h.execution = bp_turnover.execution AND h.missing_policy = bp_turnover.missing_policy)")
def set01(spark, sf):
    return round_to(portfolio_weeks(spark, sf).select(*SG.VARIANT, "week_no", "turnover"), 8, "turnover")


cte("bp_series", "SELECT concat_ws('|', portfolio, execution, missing_policy) AS series_id, week_no - 1 AS idx, gross_return - cost AS ret FROM bp_weeks")
score_ctes("bp", "bp_series")
_BPS = "series_id, n, round(sr, 6) AS sr, effective_t, round(psr0, 6) AS psr0"


@query("scr22_portfolio_trials", f"SELECT {_BPS} FROM bp_score")
def scr22(spark, sf):
    """Scores of the eight portfolio variants, the trial family of the deflated gate."""
    weeks = portfolio_weeks(spark, sf)
    series = weeks.select(F.concat_ws("|", *SG.VARIANT).alias("series_id"), (F.col("week_no") - 1).alias("idx"), F.col("net_return").alias("ret"))
    return round_to(S.score_series(stage(series, "series")).select("series_id", "n", "sr", "effective_t", "psr0"), 6, "sr", "psr0")


# ---- audits, fingerprints, trials -----------------------------------------------------------------

@query("set03_panel_difference", """
SELECT 'left' AS side, symbol, date FROM bars WHERE NOT (symbol IN (SELECT symbol FROM universe WHERE eligible)) UNION ALL
SELECT 'right', symbol, date - 7000 FROM bars WHERE symbol = 'Brand#1'""")
def set03(spark, sf):
    """Rows two versions of a panel do not share: one lost symbols, the other gained moved rows."""
    base = stage(bars(spark, sf), "bars")
    flagged = P.liquid_universe(P.weekly_panel(base), top_n=10)
    full = base.select("symbol", "date")
    moved = full.filter("symbol = 'Brand#1'").select("symbol", F.date_sub("date", 7000).alias("date"))
    other = P.trim_to(full, P.ever_eligible(flagged)).unionByName(moved)
    from ..operators.validate import symmetric_difference

    return symmetric_difference(full, other)


cte("fp_lines", """
SELECT symbol, sha256(concat_ws('|', strftime(date, '%Y-%m-%d'), symbol, CAST(round(close * 1e6) AS BIGINT), CAST(round(dollar_volume * 100) AS BIGINT))) AS d FROM bars""")
cte("fp_leaves", """
SELECT symbol, d[:2] AS p, sha256(string_agg(d || '*' || n, chr(10) ORDER BY d || '*' || n)) AS h, sum(n) AS n
FROM (SELECT symbol, d, count(*) AS n FROM fp_lines GROUP BY 1, 2) GROUP BY 1, 2""")
cte("fp_inner", "SELECT symbol, p[:1] AS p, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM fp_leaves GROUP BY 1, 2")
cte("fp_roots", "SELECT symbol, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM fp_inner GROUP BY 1")
cte("fp_names", """
SELECT sha256(symbol)[:2] AS p, sha256(string_agg(symbol || '=' || h, chr(10) ORDER BY symbol || '=' || h)) AS h, sum(n) AS n FROM fp_roots GROUP BY 1""")


@query("src12_content_fingerprint", """
SELECT sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS n_rows FROM (
  SELECT p[:1] AS p, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM fp_names GROUP BY 1)""")
def src12(spark, sf):
    rows = bars(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumns(
        {"close": F.round(F.col("close") * 1e6).cast("bigint"), "dollar_volume": F.round(F.col("dollar_volume") * 100).cast("bigint")}
    )
    return FP.content_fingerprint(rows, "symbol", ["date", "symbol", "close", "dollar_volume"], levels=2)


@query("trl01_recorded_trials", """
SELECT series_id AS dataset_fingerprint, 'bars' AS strategy_family, round(sr, 9) AS sr, n AS t_observations FROM bar_moments UNION ALL
SELECT series_id, 'assets', round(sr, 9), n FROM asset_moments""")
def trl01(spark, sf):
    """Two appends to one trial table, read back."""
    path = scratch_path(spark, "trials")
    for family, series in (("bars", bar_series(spark, sf)), ("assets", asset_series(spark, sf))):
        TR.record_trials(trial_rows(R.return_moments(series), family), path)
    out = TR.read_trials(spark, path).select("dataset_fingerprint", "strategy_family", "sr", "t_observations")
    return round_to(out, 9, "sr")


def trial_rows(moments, family: str, fingerprint=None):
    return moments.select(
        (F.col("series_id") if fingerprint is None else F.lit(fingerprint)).alias("dataset_fingerprint"), F.lit(family).alias("strategy_family"),
        "sr", F.col("n").alias("t_observations"), "skew", "kurt", F.to_json(F.struct("status", "mean", "std")).alias("metadata_json"),
    )


@query("trl02_trial_spread", """
SELECT 'all' AS dataset_fingerprint, 'bars' AS strategy_family, count(*) AS n_trials, 8 AS n_effective, round(var_samp(sr), 10) AS v_sr FROM bar_moments UNION ALL
SELECT 'all', 'assets', count(*), 8, round(var_samp(sr), 10) FROM asset_moments""")
def trl02(spark, sf):
    rows = trial_rows(R.return_moments(bar_series(spark, sf)), "bars", "all").unionByName(trial_rows(R.return_moments(asset_series(spark, sf)), "assets", "all"))
    return round_to(TR.trial_spread(TR.checked_trials(rows), 8), 10, "v_sr")
