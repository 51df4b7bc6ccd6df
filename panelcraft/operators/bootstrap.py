"""Stationary block bootstrap as joins: resampled paths and intervals of means and slopes.

Every draw is a hash of (seed, series, path, block), so a retried or moved task repeats it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.windows import running
from .returns import KEY
from .scoring import block_lengths, effective_size


def with_blocks(series: DataFrame, least: float = 2.0) -> DataFrame:
    """Series id and the expected block length to resample it with."""
    return block_lengths(series).withColumn("block", F.greatest("block", F.lit(least)))


def block_draws(series: DataFrame, n_paths: int, blocks: DataFrame, seed: int) -> DataFrame:
    """The blocks of `n_paths` copies of each series: rows (series_id, path, n, begin, len, start).

    A block starts at a uniform place of the series and has a geometric length with the expected block length as
    its mean; blocks follow one another until the copy is as long as the series, and the last is cut there.
    A path draws its expected number of blocks and ten deviations more, and the last one drawn runs to the end
    whatever its length. Only blocks are rows, not positions.
    """
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).join(blocks, "series_id")
    need = F.col("n") / F.col("block")
    # few bytes here, many rows below: a stated number of partitions keeps adaptive execution from joining them
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))).repartition(tasks, "series_id", "path")
    cells = cells.withColumn("top", F.ceil(need + 10.0 * F.sqrt(need)) + 20).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id", "path", "k"))
    # half a step off zero, so that no draw lies on the edge between two lengths
    place, gap = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for at in (1, 9))
    length = F.when(F.col("block") > 1, 1 + F.floor(F.ln(gap) / F.ln(1.0 - 1.0 / F.col("block")))).otherwise(F.lit(1).cast("bigint"))
    length = F.when(F.col("k") == F.col("top"), F.col("n")).otherwise(length)
    drawn = cells.select("series_id", "path", "n", "k", length.alias("len"), F.floor(place * F.col("n")).alias("start"))
    placed = drawn.withColumn("begin", F.sum("len").over(running(["series_id", "path"], "k")) - F.col("len")).filter("begin < n")
    return placed.select("series_id", "path", "n", "begin", F.least(F.col("len"), F.col("n") - F.col("begin")).alias("len"), "start")


def resample(series: DataFrame, n_paths: int, blocks: DataFrame, seed: int) -> DataFrame:
    """`n_paths` resampled copies of each series, row by row: (series_id, path, pos, ret)."""
    drawn = block_draws(series, n_paths, blocks, seed).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)))
    cells = drawn.select(
        "series_id", "path", (F.col("begin") + F.col("_i")).alias("pos"), ((F.col("start") + F.col("_i")) % F.col("n")).alias("idx"))
    return cells.join(series.select("series_id", "idx", "ret"), ["series_id", "idx"]).select("series_id", "path", "pos", "ret")


def path_means(series: DataFrame, n_paths: int, blocks: DataFrame, seed: int) -> DataFrame:
    """Mean of every resampled copy, from differences of one running sum: no copy is ever laid out.

    A block that runs past the end goes on at the start; it may go round several times.
    """
    upto = series.withColumn("upto", F.sum("ret").over(running(["series_id"], "idx"))).select("series_id", "idx", "upto")
    whole = series.groupBy("series_id").agg(F.sum("ret").alias("whole"))
    drawn = block_draws(series, n_paths, blocks, seed).withColumn("stop", F.col("start") + F.col("len"))
    # the block's sum is upto(stop - 1) - upto(start - 1), plus the whole for each turn
    edges = drawn.select("series_id", "path", "n", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), (F.col("start") - 1).alias("idx"), F.lit(0).cast("bigint").alias("turns")),
        F.struct(F.lit(1).alias("sign"), ((F.col("stop") - 1) % F.col("n")).alias("idx"), F.floor((F.col("stop") - 1) / F.col("n")).alias("turns")),
    )).alias("e"))
    edges = edges.select("series_id", "path", "n", "e.*").groupBy("series_id", "path", "n", "idx").agg(
        F.sum("sign").alias("times"), F.sum("turns").alias("turns"))
    value = F.col("times") * F.coalesce("upto", F.lit(0.0)) + F.col("turns") * F.col("whole")
    return edges.join(upto, ["series_id", "idx"], "left").join(whole, "series_id").groupBy("series_id", "path").agg(
        (F.sum(value) / F.first("n")).alias("value"))


def interval(values: DataFrame, alpha: float = 0.05, keys: Sequence[str] = KEY) -> DataFrame:
    """Two-sided interval of path values by linear interpolation."""
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def interval_by_rank(values: DataFrame, alpha: float = 0.05, keys: Sequence[str] = KEY) -> DataFrame:
    """Two-sided interval of path values at the truncated rank `int(q * n)`; the path count bounds the array."""
    grouped = values.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_v"))

    def at(q: float):
        n = F.size("_v")
        return F.get("_v", F.least(n - 1, F.greatest(F.lit(0), F.floor(q * n).cast("int"))))

    return grouped.select(*keys, at(alpha / 2).alias("ci_low"), at(1 - alpha / 2).alias("ci_high"))


def mean_interval(series: DataFrame, n_paths: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Mean, bootstrap interval, effective size and block length of every series."""
    blocks = with_blocks(series)
    stats = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))
    return (
        stats.join(interval(path_means(series, n_paths, blocks, seed), alpha), "series_id")
        .join(blocks, "series_id").withColumn("effective_t", effective_size(F.col("n"), F.col("block")))
    )


def difference_interval(series: DataFrame, side: str, n_paths: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Difference of means between the `post_etf` and `pre_etf` rows of each series, with an interval
    from independent resamples of the two sides paired by path number.

    `side` names the column that tells the two apart; positions must count within each side.
    """
    keyed = series.withColumn("series_id", F.concat_ws("#", "series_id", side))
    means = path_means(keyed, n_paths, with_blocks(keyed), seed)
    split = means.withColumn("_side", F.element_at(F.split("series_id", "#"), -1)).withColumn(
        "series_id", F.element_at(F.split("series_id", "#"), 1)
    )

    def pick(s: str, c: str):
        return F.max(F.when(F.col("_side") == s, F.col(c)))

    paired = split.groupBy("series_id", "path").agg((pick("post_etf", "value") - pick("pre_etf", "value")).alias("value"))
    stats = series.groupBy("series_id").agg(
        F.avg(F.when(F.col(side) == "pre_etf", F.col("ret"))).alias("pre_mean"),
        F.avg(F.when(F.col(side) == "post_etf", F.col("ret"))).alias("post_mean"),
        F.count_if(F.col(side) == "pre_etf").alias("n_pre"), F.count_if(F.col(side) == "post_etf").alias("n_post"),
    )
    return stats.withColumn("difference", F.col("post_mean") - F.col("pre_mean")).join(
        interval(paired.filter("value IS NOT NULL"), alpha), "series_id"
    )


#: Groups that the paths of a series are dealt to.
PATH_GROUPS = 16


def path_products(series: DataFrame, weights: DataFrame, n_paths: int, blocks: DataFrame, seed: int) -> DataFrame:
    """Sum over positions of weight times resampled value, for every path: rows (series_id, path, value).

    `weights` has a `w` per (series_id, idx). Only blocks are rows. Values and weights of a series, one number a day, meet
    the blocks of some of its paths in one task, which adds up the products along each block; a block that runs past the
    end goes on at the start.
    """
    sides = series.join(weights, ["series_id", "idx"]).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ret", "w"))).alias("rows"))
    sides = sides.select(F.col("series_id").alias("id"), "rows", F.explode(F.sequence(F.lit(0), F.lit(PATH_GROUPS - 1))).alias("group"))
    drawn = block_draws(series, n_paths, blocks, seed).withColumn("part", F.pmod("path", F.lit(PATH_GROUPS)))

    def add(drawn: pa.Table, sides: pa.Table) -> pa.Table:
        if not drawn.num_rows or not sides.num_rows:
            return pa.table({"series_id": pa.array([], pa.string()), "path": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        rows = sides["rows"].combine_chunks().flatten()
        ret, w = rows.field("ret").to_numpy(zero_copy_only=False), rows.field("w").to_numpy(zero_copy_only=False)
        path, begin, length, start = (drawn[c].to_numpy() for c in ("path", "begin", "len", "start"))
        block = np.repeat(np.arange(len(path)), length)
        inside = np.arange(len(block)) - (np.cumsum(length) - length)[block]
        products = w[begin[block] + inside] * ret[(start[block] + inside) % len(ret)]
        paths, code = np.unique(path, return_inverse=True)
        return pa.table({"series_id": pa.array([drawn["series_id"][0].as_py()] * len(paths), pa.string()), "path": pa.array(paths.astype(np.int32)),
                         "value": np.bincount(code[block], products, len(paths))})

    return drawn.groupBy("series_id", "part").cogroup(sides.groupBy("id", "group")).applyInArrow(add, "series_id string, path int, value double")


def trend_interval(series: DataFrame, n_paths: int, seed: int, alpha: float = 0.05, per_year: float = 365.0) -> DataFrame:
    """Slope per year of each series with an interval from resampled residuals.

    The slope of fit plus resampled residuals is the fitted slope plus the residuals' product with the centred calendar.
    """
    origin = series.groupBy("series_id").agg(F.min("dt").alias("_first"))
    timed = series.join(origin, "series_id").withColumn("years", F.datediff("dt", "_first") / per_year)
    fit = timed.groupBy("series_id").agg(
        F.regr_slope("ret", "years").alias("slope"), F.regr_intercept("ret", "years").alias("intercept"), F.avg("years").alias("_mean"), F.regr_sxx("ret", "years").alias("_sxx")
    )
    fitted = timed.join(fit, "series_id")
    residuals = fitted.select("series_id", "idx", (F.col("ret") - F.col("intercept") - F.col("slope") * F.col("years")).alias("ret"))
    weights = fitted.select("series_id", "idx", F.try_divide(F.col("years") - F.col("_mean"), F.col("_sxx")).alias("w"))
    moved = path_products(residuals, weights, n_paths, with_blocks(residuals), seed).join(fit.select("series_id", "slope"), "series_id")
    slopes = moved.select("series_id", "path", (F.col("slope") + F.col("value")).alias("value"))
    return fit.select("series_id", "slope").join(interval(slopes, alpha), "series_id")
