"""What decides a study: scores per recency slice, split stress of deflated ratios, cost grids, overlap with another study."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normal import dsr
from ..functions.windows import over, with_grid
from .crossval import test_series
from .returns import KEY
from .scoring import moved_scores, phase_bands, score_series, trial_variance

#: Days below which a slice or an overlap says nothing.
LEAST_DAYS = 126
BAR = 0.95


def recency_scores(series: DataFrame, slices: Sequence[Mapping[str, str]], least_rows: int = LEAST_DAYS) -> DataFrame:
    """Score of every series from each start date on (`slice`, `start`); slices with fewer rows are left out."""
    sliced = with_grid(series, slices).filter(F.col("dt") >= F.col("start").cast("date"))
    idx = F.row_number().over(over(["series_id", "slice"], "idx")) - 1
    return score_series(sliced.select("series_id", "slice", idx.alias("idx"), "ret"), ["series_id", "slice"]).filter(F.col("n") >= least_rows)


def cost_grid(scores: DataFrame, costs: Sequence[float], per_year: float) -> DataFrame:
    """Scores at several yearly costs taken evenly from every day: scored once, moved in closed form."""
    return moved_scores(with_grid(scores, [{"cost_annual": float(c)} for c in costs]), F.col("cost_annual") / per_year)


def family_ladder(scores: DataFrame, headline: Column, trials: Sequence[int], least_trials: int) -> DataFrame:
    """Deflated ratio of one member of a family at assumed trial counts; the variance is that of the family.

    `passes` tells whether the member stands at `least_trials`.
    """
    spread = {"n_variants": scores.agg(F.count("sr")).scalar(), "v_sr": scores.agg(F.coalesce(F.var_samp("sr"), F.lit(0.0))).scalar()}
    out = with_grid(scores.filter(headline).withColumns(spread), [{"trials": t} for t in trials])
    out = out.withColumn("dsr", dsr(F.col("sr"), F.col("effective_t"), F.col("skew"), F.col("kurt"), F.col("v_sr"), F.col("trials")))
    return out.withColumn("passes", F.coalesce((F.col("trials") == least_trials) & (F.col("dsr") >= BAR), F.lit(False)))


def split_stress(series: DataFrame, n_groups: int = 6, k_test: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """Range over the combinatorial splits of the probability that a series' true ratio is positive, and the smallest test set.

    Every series has a row: `split_status` is `too_short` where it has fewer rows than groups and so no split.
    """
    scores = score_series(test_series(series, n_groups, k_test, keys), [*keys, "split_id"])
    sizes = scores.groupBy(*keys).agg(F.min("n").alias("min_test"))
    lengths = series.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < n_groups, "too_short").otherwise("ok").alias("split_status"))
    return lengths.join(phase_bands(scores, keys).join(sizes, list(keys)), list(keys), "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0).cast("bigint")))


def deflated_gate(series: DataFrame, family: DataFrame, bar: float = BAR) -> DataFrame:
    """Deflated ratio of each series over all rows and over the test rows of every combinatorial split.

    Number and variance of trials come from the scores of the whole family. The worst split decides.
    """
    trials = trial_variance(family)
    spread = {c: trials.select(c).scalar() for c in ("n_trials", "v_sr")}

    def deflated(scores: DataFrame) -> DataFrame:
        value = dsr(F.col("sr"), F.col("effective_t"), F.col("skew"), F.col("kurt"), F.col("v_sr"), F.col("n_trials"))
        return scores.withColumns(spread).withColumn("dsr", value)

    splits = phase_bands(deflated(score_series(test_series(series), ["series_id", "split_id"])), ["series_id"], "dsr")
    whole = deflated(score_series(series)).select("series_id", "n", "effective_t", "sr", "n_trials", "v_sr", F.col("dsr").alias("full_dsr"))
    out = whole.join(splits.select("series_id", F.col("min").alias("split_min"), F.col("median").alias("split_median"), F.col("max").alias("split_max"), "n_scored"), "series_id")
    return out.withColumn("passes", F.coalesce(F.col("split_min") >= bar, F.lit(False)))


def two_portfolio_verdict(gate: DataFrame, deployable: str, benchmark: str) -> DataFrame:
    """One row: the deployable portfolio decides; a benchmark that passes does not rescue it."""
    def passed(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("passes") & (F.col("series_id") == name)), F.lit(False))

    out = gate.agg(passed(deployable).alias("deployable_passes"), passed(benchmark).alias("benchmark_passes"))
    return out.withColumn("verdict", F.when(F.col("deployable_passes"), "not_killed").when(F.col("benchmark_passes"), "non_viable_benchmark_only").otherwise("non_viable"))


def overlap(a: DataFrame, b: DataFrame, per_year: float, least_days: int = LEAST_DAYS) -> DataFrame:
    """How much of one study's bet is another's: both have (date, ret, active).

    Days in common, correlation of returns and of the invested shares, and the yearly ratio of half and half. With too few
    days or no spread a number is 0.
    """
    both = a.select("date", F.col("ret").alias("_ra"), F.col("active").alias("_aa")).join(b.select("date", F.col("ret").alias("_rb"), F.col("active").alias("_ab")), "date")
    half = 0.5 * F.col("_ra") + 0.5 * F.col("_rb")
    agg = both.agg(
        F.count(F.lit(1)).alias("n_aligned"), F.corr("_ra", "_rb").alias("_rc"), F.corr("_aa", "_ab").alias("_ac"), F.avg(half).alias("_m"), F.stddev_samp(half).alias("_s"),
        F.var_pop("_ra").alias("_va"), F.var_pop("_rb").alias("_vb"), F.var_pop("_aa").alias("_wa"), F.var_pop("_ab").alias("_wb"),
    )
    enough = F.col("n_aligned") >= least_days

    def known(value: Column, *spreads: str) -> Column:
        ok = enough
        for s in spreads:
            ok = ok & (F.col(s) > 0)
        return F.when(ok, value).otherwise(0.0)

    return agg.select(
        "n_aligned", known(F.col("_rc"), "_va", "_vb").alias("return_corr"), known(F.col("_ac"), "_wa", "_wb").alias("active_corr"),
        known(F.col("_m") / F.col("_s") * per_year**0.5, "_s").alias("combo_sharpe"))
