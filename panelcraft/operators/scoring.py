"""Significance of return series: block length, effective sample size, Sharpe probabilities, verdicts.

Variants, phases, splits and slices are all just more keys of the series table, so any number of them
is scored in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.normal import dsr, psr
from ..functions.windows import with_grid
from .returns import KEY, return_moments

MIN_LENGTH = 11
CHUNK_ROWS = 4096


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lag_sums(values: pd.Series, own: pd.Series, start: pd.Series, n: pd.Series, lags: pd.Series) -> pd.Series:
    """Per chunk of a series, for each lag: the lagged cross product of its own rows, the squares past
    the lag, and the squares before the last lag rows; the three blocks laid end to end."""
    out = []
    for e, k, s, total, m in zip(values, own, start, n, lags):
        e = np.asarray(e, dtype=float)
        squares = np.concatenate([[0.0], np.cumsum(e[:k] ** 2)])
        i = np.arange(m + 1)
        cross = [float(e[: min(k, max(len(e) - j, 0))] @ e[j : j + min(k, max(len(e) - j, 0))]) for j in i]
        past = squares[-1] - squares[np.clip(i + 1 - s, 0, k)]
        before = squares[np.clip(total - 1 - i - s, 0, k)]
        out.append(np.concatenate([cross, past, before]))
    return pd.Series(out)


def _with_blocks(series: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Moments of every series and its block length, reading the series twice: once to aggregate, once to chunk."""
    keys = list(keys)
    run = F.greatest(F.lit(5), F.floor(F.log10(F.greatest("n", F.lit(1))))).cast("int")
    moments = return_moments(series, keys)
    stats = (
        moments.select(*keys, F.struct(*[c for c in moments.columns if c not in keys]).alias("_stats"))
        .withColumn("n", F.col("_stats.n")).withColumn("_run", run)
        .withColumn("_m", (F.ceil(F.sqrt("n")) + F.col("_run")).cast("int"))
        .withColumn("_size", F.greatest(F.lit(chunk_rows), F.col("_m") + 1).cast("bigint"))
    )
    chunk = F.floor(F.col("idx") / F.col("_size"))
    reaches_back = (F.col("_chunk") > 0) & (F.col("idx") - F.col("_chunk") * F.col("_size") < F.col("_m"))
    placed = (
        series.select(*keys, "idx", "ret").join(stats, keys)
        .withColumn("_chunk", chunk)
        .withColumn(
            "_to", F.explode(F.when(reaches_back, F.array(F.col("_chunk"), F.col("_chunk") - 1)).otherwise(F.array("_chunk")))
        )
        .withColumn("_own", F.col("_to") == F.col("_chunk"))
    )
    ids = [*keys, "n", "_run", "_m"]
    chunks = placed.groupBy(*ids, "_size", "_to").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("idx", (F.col("ret") - F.col("_stats.mean")).alias("e")))), lambda x: x["e"]
        ).alias("_values"),
        F.count_if("_own").alias("_k"), F.first("_stats").alias("_stats"),
    )
    sums = chunks.select(
        *ids, "_stats", F.posexplode(_lag_sums("_values", "_k", F.col("_to") * F.col("_size"), "n", "_m")).alias("_pos", "_v")
    ).groupBy(*ids, "_pos").agg(F.sum("_v").alias("_v"), F.first("_stats").alias("_stats"))
    folded = sums.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias("_s"), F.first("_stats").alias("_stats")
    )
    width = F.col("_m") + 1

    def cross(i: Column) -> Column:
        return F.get("_s", i)

    def quiet(i: Column) -> Column:
        scale = F.get("_s", width + i) * F.get("_s", 2 * width + i)
        cut = 2.0 * F.sqrt(F.log10("n") / F.col("n"))
        return F.when(scale > 0, F.abs(cross(i)) / F.sqrt(scale) < cut).otherwise(False)

    def weight(k: Column) -> Column:
        share = k / F.col("_bw")
        return 2.0 * F.when(share <= 0.5, F.lit(1.0)).otherwise(2.0 * (1.0 - share)) * cross(k) / F.col("n")

    lags = F.sequence(F.lit(1), F.col("_bw"))
    zero = F.lit(0.0)
    calm = F.transform(F.sequence(F.lit(0), F.col("_m")), quiet)
    starts = F.filter(
        F.sequence(F.lit(0), F.col("_m") - F.col("_run")),
        lambda s: F.forall(F.slice("_calm", s + 1, F.col("_run")), lambda q: q),
    )
    cap = F.ceil(F.least(3.0 * F.sqrt("n"), F.col("n") / 3.0)).cast("double")
    raw = F.cbrt(F.pow(F.col("_g") / F.nullif(F.col("_lr"), F.lit(0.0)), F.lit(2.0)) * F.col("n"))
    block = F.when((F.col("n") < MIN_LENGTH) | (F.col("_lr") == 0), 1.0).otherwise(F.coalesce(F.least(raw, cap), F.lit(1.0)))
    return (
        folded.withColumn("_calm", calm).withColumn("_first", F.get(starts, F.lit(0)))
        .withColumn("_bw", F.when(F.col("_first").isNull(), F.col("_m")).otherwise(F.least(2 * F.greatest(F.col("_first"), F.lit(1)), F.col("_m"))))
        .withColumns({
            "_g": F.aggregate(lags, zero, lambda a, k: a + weight(k) * k),
            "_lr": F.aggregate(lags, cross(F.lit(0)) / F.col("n"), lambda a, k: a + weight(k)),
        })
        .select(*keys, "_stats.*", block.alias("block"))
    )


def block_lengths(series: DataFrame, keys: Sequence[str] = KEY, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Automatic mean block length of the stationary bootstrap (Politis-White 2004, corrected 2009).

    A series is cut into chunks of consecutive rows, each extended by the few rows its lags reach into.
    Chunks give partial sums per lag, so no task holds a whole series and no row is repeated per lag.
    Series shorter than 11 rows get 1.
    """
    return _with_blocks(series, keys, chunk_rows).select(*keys, "block")


def effective_size(n: Column, block: Column, least_block: float = 1.0) -> Column:
    """Observations left after dividing by the block length, at least two."""
    return F.greatest(F.lit(2).cast("bigint"), F.floor(n / F.greatest(F.lit(least_block), block)))


def score_series(series: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Moments, block length, effective size and the probability of a positive true Sharpe, per series."""
    scored = _with_blocks(series, keys, CHUNK_ROWS).withColumn("effective_t", effective_size(F.col("n"), F.col("block")))
    zero = F.lit(0.0)
    return scored.withColumn("psr0", psr(F.col("sr"), zero, F.col("effective_t"), F.col("skew"), F.col("kurt")))


def moved_scores(scores: DataFrame, cost: Column) -> DataFrame:
    """Scores of the same series with a constant cost taken from every row.

    The mean alone moves: deviation, block length, skewness and kurtosis stay, so nothing is scored again.
    """
    out = scores.withColumn("mean", F.col("mean") - cost).withColumn("sr", F.when(F.col("sr").isNotNull(), F.col("mean") / F.col("std")))
    return out.withColumn("psr0", psr(F.col("sr"), F.lit(0.0), F.col("effective_t"), F.col("skew"), F.col("kurt")))


def trial_variance(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of variants and sample variance of their Sharpe ratios (zero for a single one)."""
    return scores.groupBy(*keys).agg(
        F.count("sr").alias("n_trials"), F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("v_sr")
    )


def deflation_ladder(
    headline: DataFrame, variants: DataFrame, trials: Sequence[int], keys: Sequence[str]
) -> DataFrame:
    """Deflated Sharpe of each headline series at assumed trial counts, the variance from its variants."""
    spread = trial_variance(variants, keys)
    out = with_grid(headline.join(spread, list(keys)), [{"trials": t} for t in trials])
    value = dsr(F.col("sr"), F.col("effective_t"), F.col("skew"), F.col("kurt"), F.col("v_sr"), F.col("trials"))
    return out.withColumn("dsr", value)


def phase_bands(scores: DataFrame, keys: Sequence[str], value: str = "psr0") -> DataFrame:
    """Median, minimum and maximum of a score over phases or splits."""
    return scores.groupBy(*keys).agg(
        F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("n_scored"),
    )


def verdict(
    scores: DataFrame, bars: Mapping[str, float], stress: Sequence[str] = ()
) -> DataFrame:
    """Pass flags, regime dependence and reason text for a table of scores.

    `bars` maps a column to its limit: `psr0` must reach it, every other column must not exceed it.
    A pass with a stress score below the `psr0` limit counts as regime dependent.
    """
    def passes(c: str) -> Column:
        ok = F.col(c) >= bars[c] if c == "psr0" else F.col(c) <= bars[c] + 1e-12
        return F.coalesce(ok, F.lit(False))

    flags = {c: passes(c) for c in bars}
    text = [
        F.when(~F.col(f"passes_{c}"), F.lit(f"{c} {'below' if c == 'psr0' else 'above'} {bars[c]:.2f}")) for c in bars
    ]
    out = scores.withColumns({f"passes_{c}": flag for c, flag in flags.items()})
    every = F.lit(True)
    for c in bars:
        every = every & F.col(f"passes_{c}")
    out = out.withColumn("passes", every)
    weak = F.lit(False)
    for c in stress:
        weak = weak | F.coalesce(F.col(c) < bars["psr0"], F.lit(False))
    headline = (
        F.when(~F.col("passes"), "non_viable").when(F.col("regime_dependent"), "regime_dependent").otherwise("not_killed")
    )
    return (
        out.withColumn("regime_dependent", F.col("passes") & weak)
        .withColumn("verdict", headline).withColumn("reason", F.concat_ws("; ", *text))
    )


def cost_share(paid: Column, gain: Column) -> Column:
    """Cost paid over gain; NULL (unbounded) when there is no gain."""
    return F.when(gain > 0, paid / gain)
