"""Return-series, significance, resampling and cross-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions.windows import over, with_grid
from ..operators import bootstrap as B
from ..operators import crossval as CV
from ..operators import returns as R
from ..operators import scoring as S
from .inputs import asset_series, bar_series, round_to
from .registry import cte, query
from .stage import stage
from .sqltext import max_sharpe, phi, phi_inv, psr_of, score_ctes, variance

score_ctes("bar", "bar_series")
score_ctes("asset", "asset_series")

_PAIR = """SELECT a.series_id, a.idx, a.dt, a.ret AS a, b.ret AS b FROM asset_series a
JOIN (SELECT dt, avg(ret) AS ret FROM asset_series GROUP BY 1) b USING (dt)"""
cte("pair", _PAIR)


def pair(spark, sf):
    """Each asset's returns beside the all-asset mean."""
    series = asset_series(spark, sf)
    mean = series.groupBy("dt").agg(F.avg("ret").alias("b"))
    return series.withColumnRenamed("ret", "a").join(mean, "dt")


@query("agg10_monthly_difference", """
SELECT series_id, dt, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS idx, round(ret, 8) AS ret FROM (
  SELECT series_id, CAST(date_trunc('month', dt) AS DATE) AS dt, product(1 + a) - product(1 + b) AS ret FROM pair GROUP BY 1, 2)""")
def agg10(spark, sf):
    return round_to(R.monthly_difference(pair(spark, sf), "a", "b"), 8, "ret")


@query("agg11_growth_summary", """
SELECT series_id, round(g, 8) AS total_gain, round(CASE WHEN g <= -1 THEN -1 ELSE power(1 + g, 1 / years) - 1 END, 8) AS cagr,
       round(sd * sqrt(252), 8) AS ann_vol, round(CASE WHEN sd > 0 THEN m / sd * sqrt(252) END, 8) AS ann_sharpe
FROM (SELECT series_id, product(1 + ret) - 1 AS g, greatest((max(dt) - min(dt)) / 365.0, 1e-12) AS years, avg(ret) AS m, stddev_samp(ret) AS sd
      FROM asset_series GROUP BY 1)""")
def agg11(spark, sf):
    return round_to(R.growth_summary(asset_series(spark, sf)), 8, "total_gain", "cagr", "ann_vol", "ann_sharpe")


_MOMENT_COLS = ("mean", "std", "sr", "skew", "kurt")
_MOMENTS = "series_id, n, status, " + ", ".join(f"round({c}, 7) AS {c}" for c in _MOMENT_COLS)


@query("agg12_return_moments", f"SELECT {_MOMENTS} FROM bar_moments")
def agg12(spark, sf):
    return round_to(R.return_moments(bar_series(spark, sf)), 7, *_MOMENT_COLS)


cte("asset_wealth", "SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY idx) AS wealth FROM asset_series")


@query("win08_max_drawdown", """
SELECT series_id, round(max(1 - wealth / peak), 8) AS max_drawdown FROM (
  SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY series_id ORDER BY idx)) AS peak FROM asset_wealth) GROUP BY 1""")
def win08(spark, sf):
    return round_to(R.max_drawdown(R.wealth(asset_series(spark, sf)), "wealth"), 8, "max_drawdown")


@query("win08_additive_drawdown", """
SELECT series_id, round(max(peak - s), 8) AS max_drawdown FROM (SELECT *, greatest(0, max(s) OVER (PARTITION BY series_id ORDER BY idx)) AS peak FROM (
  SELECT *, sum(ret) OVER (PARTITION BY series_id ORDER BY idx) AS s FROM asset_series)) GROUP BY 1""")
def win08_additive(spark, sf):
    return round_to(R.additive_drawdown(asset_series(spark, sf), "ret"), 8, "max_drawdown")


@query("win18_wealth_index", "SELECT series_id, idx, dt, round(wealth, 8) AS wealth FROM asset_wealth")
def win18(spark, sf):
    return round_to(R.wealth(asset_series(spark, sf)).drop("ret"), 8, "wealth")


@query("win18_wealth_ratio", """
SELECT series_id, idx, dt, round(product(1 + a) OVER w / product(1 + b) OVER w, 8) AS ratio FROM pair WINDOW w AS (PARTITION BY series_id ORDER BY idx)""")
def win18_ratio(spark, sf):
    both = pair(spark, sf)
    a = both.select("series_id", "idx", "dt", F.col("a").alias("ret"))
    b = both.select("series_id", "idx", F.col("b").alias("ret"))
    return round_to(R.wealth_ratio(a, b).select("series_id", "idx", "dt", "ratio"), 8, "ratio")


@query("sig12_linear_trend", """
SELECT series_id, round(regr_slope(ret, years), 8) AS slope, round(regr_intercept(ret, years), 8) AS intercept
FROM (SELECT *, (dt - min(dt) OVER (PARTITION BY series_id)) / 365.0 AS years FROM asset_series) GROUP BY 1""")
def sig12(spark, sf):
    return round_to(R.linear_trend(asset_series(spark, sf)), 8, "slope", "intercept")


@query("sig13_redundancy", """
SELECT series_id, count(*) AS n_aligned, round(corr(a, b), 8) AS corr, round(avg((a + b) / 2) / stddev_samp((a + b) / 2) * sqrt(252), 8) AS combo_ann_sharpe
FROM pair GROUP BY 1""")
def sig13(spark, sf):
    series = asset_series(spark, sf)
    mean = series.groupBy("dt").agg(F.avg("ret").alias("ret"))
    return round_to(R.redundancy(series, mean), 8, "corr", "combo_ann_sharpe")


@query("scr01_sharpe_probability", psr_of(
    "(SELECT *, star / 100.0::DOUBLE AS s FROM bar_moments, (VALUES (0), (2), (-2)) v(star))", "series_id, star", "sr", "s", "n", "skew", "kurt", "p"
).replace("SELECT series_id, star, ", "SELECT series_id, star, round(", 1).replace(" END AS p FROM", " END, 8) AS p FROM", 1))
def scr01(spark, sf):
    m = with_grid(R.return_moments(bar_series(spark, sf)), [{"star": 0}, {"star": 2}, {"star": -2}])
    p = N.psr(F.col("sr"), F.col("star") / 100.0, F.col("n"), F.col("skew"), F.col("kurt"))
    return m.select("series_id", "star", F.round(p, 8).alias("p"))


_DSR = psr_of(
    f"(SELECT *, {max_sharpe('v_sr', 'trials')} AS s FROM (SELECT m.*, v_sr, trials::DOUBLE AS trials FROM bar_moments m, (SELECT var_samp(sr) AS v_sr FROM bar_moments), (VALUES (1), (8), (16), (32), (128)) v(trials)))",
    "series_id, trials", "sr", "s", "n", "skew", "kurt", "p")


@query("scr02_deflated_sharpe", f"SELECT series_id, trials::INTEGER AS trials, round(p, 8) AS dsr FROM ({_DSR})")
def scr02(spark, sf):
    m = R.return_moments(bar_series(spark, sf))
    spread = m.agg(F.var_samp("sr")).scalar()
    rows = with_grid(m.withColumn("v_sr", spread), [{"trials": t} for t in (1, 8, 16, 32, 128)])
    p = N.dsr(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), F.col("v_sr"), F.col("trials"))
    return rows.select("series_id", "trials", F.round(p, 8).alias("dsr"))


@query("scr03_min_track_record", f"""
SELECT series_id, level, CASE WHEN sr > 0 AND v > 0 THEN round(1 + v * power({phi_inv('(1.0::DOUBLE - alpha)')} / sr, 2), 4) END AS min_rows
FROM (SELECT series_id, sr, {variance('sr', 'skew', 'kurt')} AS v, level, level / 100.0::DOUBLE AS alpha FROM asset_moments, (VALUES (1), (5), (10)) a(level))""")
def scr03(spark, sf):
    m = with_grid(R.return_moments(asset_series(spark, sf)), [{"level": 1}, {"level": 5}, {"level": 10}])
    t = N.min_track_record(F.col("sr"), F.lit(0.0), F.col("level") / 100.0, F.col("skew"), F.col("kurt"))
    return m.select("series_id", "level", F.round(t, 4).alias("min_rows"))


@query("scr04_block_length", "SELECT series_id, round(block, 7) AS block FROM bar_block")
def scr04(spark, sf):
    return round_to(S.block_lengths(bar_series(spark, sf)), 7, "block")


@query("scr05_effective_size", "SELECT series_id, n, effective_t FROM bar_score")
def scr05(spark, sf):
    return S.score_series(bar_series(spark, sf)).select("series_id", "n", "effective_t")


_SCORE_COLS = (*_MOMENT_COLS, "block", "psr0")
_SCORE = "series_id, n, status, effective_t, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORE_COLS)


@query("scr06_series_score", f"SELECT {_SCORE} FROM asset_score")
def scr06(spark, sf):
    return round_to(S.score_series(stage(asset_series(spark, sf), "series")), 6, *_SCORE_COLS)


# ---- cross-validation -----------------------------------------------------------------------------

cte("labelled", """
SELECT *, coalesce(lead(dt, 21) OVER (PARTITION BY series_id ORDER BY idx), max(dt) OVER (PARTITION BY series_id)) AS horizon,
       count(*) OVER (PARTITION BY series_id) AS n,
       ntile(6) OVER (PARTITION BY series_id ORDER BY idx) - 1 AS grp FROM asset_series""")
cte("grp_borders", "SELECT series_id, grp, min(dt) AS first, max(dt) AS last, max(idx) AS fin, count(*) AS size FROM labelled GROUP BY 1, 2")
cte("combos", """
SELECT row_number() OVER (ORDER BY g1, g2) - 1 AS split_id, g1, g2
FROM (SELECT unnest(range(0, 6)) AS g1), (SELECT unnest(range(0, 6)) AS g2) WHERE g1 < g2""")


def labelled(spark, sf):
    return CV.clipped_horizons(asset_series(spark, sf), 21)


@query("scr14_contiguous_folds", """
SELECT series_id, idx, ntile(7) OVER (PARTITION BY series_id ORDER BY idx) - 1 AS fold FROM asset_series""")
def scr14(spark, sf):
    return CV.contiguous_folds(asset_series(spark, sf), 7).select("series_id", "idx", "fold")


@query("scr15_purged_kfold", """
SELECT l.series_id, l.idx, b.grp AS split_id, l.grp AS "group",
  CASE WHEN l.grp = b.grp THEN 'test' WHEN dt <= last AND horizon >= first THEN 'purged'
       WHEN l.idx > fin AND l.idx <= fin + floor(n * 0.05::DOUBLE) THEN 'embargo' ELSE 'train' END AS role
FROM labelled l JOIN grp_borders b ON l.series_id = b.series_id""")
def scr15(spark, sf):
    return CV.purged_kfold(labelled(spark, sf), 6)


@query("scr16_walk_forward", """
SELECT series_id, idx, CASE WHEN dt < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS role FROM asset_series
WHERE dt < DATE '1999-01-01' OR dt >= DATE '1999-02-01'""")
def scr16(spark, sf):
    return CV.walk_forward(asset_series(spark, sf), "1999-01-01", "1999-02-01").select("series_id", "idx", "role")


cte("cpcv", """
SELECT l.series_id, l.idx, l.ret, c.split_id, l.grp,
  CASE WHEN l.grp IN (g1, g2) THEN 'test'
       WHEN (dt <= a.last AND horizon >= a.first) OR (dt <= b.last AND horizon >= b.first) THEN 'purged'
       WHEN (l.idx > a.fin AND l.idx <= a.fin + emb) OR (l.idx > b.fin AND l.idx <= b.fin + emb) THEN 'embargo' ELSE 'train' END AS role
FROM (SELECT *, floor(n * greatest(0.05::DOUBLE, 21.5::DOUBLE / n)) AS emb FROM labelled) l, combos c
JOIN grp_borders a ON a.series_id = l.series_id AND a.grp = g1 JOIN grp_borders b ON b.series_id = l.series_id AND b.grp = g2""")


@query("scr17_combinatorial_splits", 'SELECT series_id, idx, split_id, grp AS "group", role FROM cpcv')
def scr17(spark, sf):
    return CV.combinatorial_splits(labelled(spark, sf), horizon=21)


@query("jn09_purge_overlap", "SELECT series_id, split_id, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM cpcv GROUP BY ALL")
def jn09(spark, sf):
    roles = CV.combinatorial_splits(labelled(spark, sf), horizon=21)
    return roles.groupBy("series_id", "split_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query("scr18_split_paths", """
SELECT series_id, idx, grp AS "group", round(ret, 8) AS ret, row_number() OVER (PARTITION BY series_id, idx ORDER BY split_id) - 1 AS path, split_id
FROM cpcv WHERE role = 'test'""")
def scr18(spark, sf):
    return round_to(CV.split_paths(asset_series(spark, sf)), 8, "ret")


@query("scr19_embargo_share", """
SELECT series_id, h, round(greatest(0.05::DOUBLE, (h + 0.5) / n), 10) AS pct, floor(n * greatest(0.05::DOUBLE, (h + 0.5) / n))::BIGINT AS embargo_rows
FROM (SELECT series_id, count(*)::DOUBLE AS n FROM asset_series GROUP BY 1), (VALUES (1), (21), (250)) v(h)""")
def scr19(spark, sf):
    sizes = asset_series(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    rows = with_grid(sizes, [{"h": 1}, {"h": 21}, {"h": 250}])
    pct = F.greatest(F.lit(0.05), (F.col("h") + 0.5) / F.col("n"))
    checked = F.when(pct < 1, CV.embargo_share(F.col("n"), 1) * 0 + pct)
    return rows.select("series_id", "h", F.round(checked, 10).alias("pct"), F.floor(F.col("n") * checked).alias("embargo_rows"))


@query("scr20_label_horizons", """
SELECT series_id, idx, horizon AS clipped, dt + 7 AS fixed, lead(dt, 5) OVER (PARTITION BY series_id ORDER BY idx) AS event FROM labelled""")
def scr20(spark, sf):
    base = labelled(spark, sf).withColumnRenamed("horizon", "clipped")
    base = CV.fixed_horizons(base, 7).withColumnRenamed("horizon", "fixed")
    event = CV.event_horizons(asset_series(spark, sf), 5).select("series_id", "idx", F.col("horizon").alias("event"))
    return base.join(event, ["series_id", "idx"], "left").select("series_id", "idx", "clipped", "fixed", "event")


cte("test_rows", """
SELECT series_id || '/' || split_id AS series_id, row_number() OVER (PARTITION BY series_id, split_id ORDER BY idx) - 1 AS idx, ret
FROM cpcv WHERE role = 'test'""")
score_ctes("fold", "test_rows")


@query("scr21_split_stress", """
SELECT split_part(series_id, '/', 1) AS series_id, round(median(psr0), 6) AS median, round(min(psr0), 6) AS min, round(max(psr0), 6) AS max,
       count(psr0) AS n_scored FROM fold_score GROUP BY 1""")
def scr21(spark, sf):
    series = stage(asset_series(spark, sf), "series")
    scores = S.score_series(CV.test_series(series), ["series_id", "split_id"])
    return round_to(S.phase_bands(scores, ["series_id"]), 6, "median", "min", "max")


# ---- bootstrap ------------------------------------------------------------------------------------

def boot_ctes(p: str, source: str, paths: int, seed: int, least: float = 2.0) -> None:
    """Declare `<p>_block`, `<p>_cell` and `<p>_mean`: blocks, resampled rows and path means of a scored source."""
    def u(at: int) -> str:
        return f"((cast(concat('0x', substr(digest, {at}, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    cte(f"{p}_block", f"""
SELECT series_id, path, n, start, fill - len AS lo, least(fill, n) - (fill - len) AS len FROM (
  SELECT *, sum(len) OVER (PARTITION BY series_id, path ORDER BY k)::BIGINT AS fill FROM (
    SELECT series_id, path, n, k, floor({u(1)} * n)::BIGINT AS start, CASE WHEN k = top THEN n ELSE 1 + floor(ln({u(9)}) / ln(1.0::DOUBLE - 1.0::DOUBLE / block))::BIGINT END AS len FROM (
      SELECT *, md5(concat('{seed}|', series_id, '|', path, '|', k)) AS digest FROM (
        SELECT *, unnest(range(0, top + 1)) AS k FROM (SELECT *, ceil(n / block + 10 * sqrt(n / block))::BIGINT + 20 AS top FROM (
          SELECT b.series_id, n, greatest(block, {least}) AS block, unnest(range(0, {paths})) AS path
          FROM {source}_block b JOIN {source}_stats t ON b.series_id = t.series_id)))))) WHERE fill - len < n""")
    cte(f"{p}_cell", f"""
SELECT c.series_id, path, pos, s.ret FROM (SELECT series_id, path, lo + i AS pos, (start + i) % n AS idx
  FROM (SELECT *, unnest(range(0, len)) AS i FROM {p}_block)) c
JOIN {p}_source s ON s.series_id = c.series_id AND s.idx = c.idx""")
    cte(f"{p}_mean", f"SELECT series_id, path, avg(ret) AS value FROM {p}_cell GROUP BY 1, 2")


PATHS = 2000
cte("boot_source", "SELECT * FROM asset_series")
boot_ctes("boot", "asset", PATHS, 7)


@query("scr07_bootstrap_paths", "SELECT series_id, path, round(value, 9) AS value FROM boot_mean")
def scr07(spark, sf):
    series = stage(asset_series(spark, sf), "series")
    return round_to(B.path_means(series, PATHS, B.with_blocks(series), 7), 9, "value")


@query("scr08_mean_interval_by_rank", f"""
SELECT series_id, round(list_sort(list(value))[1 + floor(0.025 * {PATHS})::INTEGER], 9) AS ci_low,
       round(list_sort(list(value))[1 + floor(0.975 * {PATHS})::INTEGER], 9) AS ci_high FROM boot_mean GROUP BY 1""")
def scr08_rank(spark, sf):
    series = stage(asset_series(spark, sf), "series")
    means = B.path_means(series, PATHS, B.with_blocks(series), 7)
    return round_to(B.interval_by_rank(means), 9, "ci_low", "ci_high")


# ---- deflation and verdict ------------------------------------------------------------------------

_LADDER = psr_of(
    f"(SELECT *, {max_sharpe('v_sr', 'trials')} AS s FROM (SELECT m.*, v_sr, trials::DOUBLE AS trials FROM asset_score m, (SELECT var_samp(sr) AS v_sr FROM asset_score), (VALUES (8), (16), (32), (128)) v(trials)))",
    "series_id, trials, v_sr", "sr", "s", "effective_t", "skew", "kurt", "p")


@query("scr22_deflation_ladder", f"SELECT series_id, trials::INTEGER AS trials, round(v_sr, 9) AS v_sr, round(p, 6) AS dsr FROM ({_LADDER})")
def scr22(spark, sf):
    scores = S.score_series(stage(asset_series(spark, sf), "series")).withColumn("family", F.lit("assets"))
    scores = stage(scores, "scores")
    out = S.deflation_ladder(scores, scores.select("family", "sr"), (8, 16, 32, 128), ["family"])
    return round_to(round_to(out.select("series_id", "trials", "v_sr", "dsr"), 9, "v_sr"), 6, "dsr")


@query("scr25_cost_share", """
SELECT series_id, round(CASE WHEN g > 0 THEN 0.0005 * n / g END, 8) AS compounded_share, round(CASE WHEN m > 0 THEN 0.0005 / m END, 8) AS arithmetic_share
FROM (SELECT series_id, product(1 + ret) - 1 AS g, count(*) AS n, avg(ret) AS m FROM bar_series GROUP BY 1)""")
def scr25(spark, sf):
    agg = bar_series(spark, sf).groupBy("series_id").agg(
        R.compounded(F.col("ret")).alias("g"), F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m")
    )
    return agg.select(
        "series_id", F.round(S.cost_share(0.0005 * F.col("n"), F.col("g")), 8).alias("compounded_share"),
        F.round(S.cost_share(F.lit(0.0005), F.col("m")), 8).alias("arithmetic_share"),
    )


@query("scr26_verdict", """
SELECT *, psr_ok AND drawdown_ok AS passes,
  CASE WHEN NOT (psr_ok AND drawdown_ok) THEN 'non_viable' WHEN low < 0.4 THEN 'regime_dependent' ELSE 'not_killed' END AS verdict,
  concat_ws('; ', CASE WHEN NOT psr_ok THEN 'psr0 below 0.40' END, CASE WHEN NOT drawdown_ok THEN 'max_drawdown above 0.35' END) AS reason
FROM (SELECT series_id, psr0 >= 0.4 AS psr_ok, dd <= 0.35 + 1e-12 AS drawdown_ok, low FROM asset_score
  JOIN (SELECT series_id, max(1 - wealth / peak) AS dd FROM (
    SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY series_id ORDER BY idx)) AS peak FROM asset_wealth) GROUP BY 1) USING (series_id)
  JOIN (SELECT split_part(series_id, '/', 1) AS series_id, min(psr0) AS low FROM fold_score GROUP BY 1) USING (series_id))""".replace("SELECT *, psr_ok AND", "SELECT * EXCLUDE (low), psr_ok AND", 1))
def scr26(spark, sf):
    series = stage(asset_series(spark, sf), "series")
    folds = S.phase_bands(S.score_series(CV.test_series(series), ["series_id", "split_id"]), ["series_id"])
    scores = (
        S.score_series(series).join(R.max_drawdown(R.wealth(series), "wealth"), "series_id")
        .join(folds.select("series_id", F.col("min").alias("fold_min")), "series_id")
    )
    out = S.verdict(scores, {"psr0": 0.4, "max_drawdown": 0.35}, ["fold_min"])
    return out.select(
        "series_id", F.col("passes_psr0").alias("psr_ok"), F.col("passes_max_drawdown").alias("drawdown_ok"),
        "passes", "verdict", "reason",
    )


cte("context", """
SELECT series_id || '/net_of_bill' AS series_id, idx, a - 0.0001 AS ret FROM pair UNION ALL
SELECT series_id || '/benchmark_net', idx, b - 0.0001 FROM pair UNION ALL
SELECT series_id || '/difference', idx, a - b FROM pair""")
score_ctes("context", "context")


@query("scr28_context_stats", """
SELECT series_id, round(sr * sqrt(252), 6) AS ann_sharpe, round(psr0, 6) AS psr0 FROM context_score""")
def scr28(spark, sf):
    """Scores of strategy and benchmark net of the bill, and of their difference, in one pass."""
    both = pair(spark, sf)
    parts = F.array(
        F.struct(F.lit("net_of_bill").alias("k"), (F.col("a") - 0.0001).alias("r")),
        F.struct(F.lit("benchmark_net").alias("k"), (F.col("b") - 0.0001).alias("r")),
        F.struct(F.lit("difference").alias("k"), (F.col("a") - F.col("b")).alias("r")),
    )
    long = both.withColumn("_p", F.explode(parts)).select(
        F.concat_ws("/", "series_id", "_p.k").alias("series_id"), "idx", F.col("_p.r").alias("ret")
    )
    out = S.score_series(long).select("series_id", (F.col("sr") * 252**0.5).alias("ann_sharpe"), "psr0")
    return round_to(out, 6, "ann_sharpe", "psr0")
