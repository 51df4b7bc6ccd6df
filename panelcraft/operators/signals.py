"""Cross-sectional signals: rank maps, weekly regressions, smoothed forecasts, selection, buckets, portfolios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.windows import all_of, average_rank, over, with_grid
from ..staging import stage
from .features import SIGNALS

# Penalty path and selection settings.
N_PENALTIES, PATH_RATIO, SELECTED_ABOVE, L1_RATIO = 50, 1e-3, 1e-8, 0.5
MAX_STEPS, SLACK = 1_000, 1e-9
#: Deviation, as part of the root mean square, below which a column counts as constant.
FLAT = 1e-12


def long_signals(frame: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """(week_end, symbol, forward_return, signal, z) from one column per signal."""
    return frame.unpivot(["week_end", "symbol", "forward_return"], list(signals), "signal", "z")


def rank_map(long: DataFrame, keys: Sequence[str] = ("week_end", "signal"), value: str = "z") -> DataFrame:
    """Replace a value by its cross-sectional average rank on [-0.5, 0.5]; NULL with fewer than two values."""
    n = F.count(value).over(Window.partitionBy(*keys))
    grouped = long.repartition(*keys)  # one exchange serves the three windows
    return grouped.withColumn("_rank", average_rank(value, keys)).withColumn("_n", n).withColumn(
        value, F.when(F.col("_n") >= 2, (F.col("_rank") - 1.0) / F.nullif(F.col("_n") - 1, F.lit(0)) - 0.5)
    ).drop("_rank", "_n")


def weekly_regressions(ranked: DataFrame) -> DataFrame:
    """Per week and signal the regression of next week's return on the ranked signal, by moments."""
    pairs = ranked.filter("z IS NOT NULL AND forward_return IS NOT NULL")
    agg = pairs.groupBy("week_end", "signal").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("z").alias("_z"), F.avg("forward_return").alias("_r"),
        F.covar_pop("z", "forward_return").alias("_c"), F.var_pop("z").alias("_v"),
    )
    beta = F.when((F.col("_n") >= 2) & (F.col("_v") > 0), F.col("_c") / F.col("_v"))
    return agg.withColumn("beta", beta).select(
        "week_end", "signal", (F.col("_r") - F.col("beta") * F.col("_z")).alias("alpha"), "beta"
    )


def smooth_coefficients(coefficients: DataFrame, window: int) -> DataFrame:
    """Mean coefficients of the previous `window` weeks, the current one excluded; all must be present."""
    w = over(["signal"], "week_end").rowsBetween(-window, -1)

    def mean(c: str) -> Column:
        return F.when(F.count(c).over(w) == window, F.avg(c).over(w))

    return coefficients.select("week_end", "signal", mean("alpha").alias("alpha_bar"), mean("beta").alias("beta_bar"))


def forecasts(ranked: DataFrame, smoothed: DataFrame) -> DataFrame:
    """One forecast per (week, symbol, signal), NULL where the signal or the history is missing."""
    joined = ranked.join(smoothed, ["week_end", "signal"], "left")
    return joined.withColumn("rhat", F.col("alpha_bar") + F.col("beta_bar") * F.col("z")).select(
        "week_end", "symbol", "forward_return", "signal", "rhat"
    )


def widen(long: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Forecasts with one column per signal."""
    return long.groupBy("week_end", "symbol", "forward_return").pivot("signal", list(signals)).agg(F.first("rhat"))


def complete_cases(long: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Per (week, symbol) the forecasts as an array in signal order, `complete` if none is missing."""
    rank = F.array_position(F.array(*[F.lit(s) for s in signals]), F.col("signal"))
    grouped = long.groupBy("week_end", "symbol", "forward_return").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("i"), "rhat"))).alias("_f"), F.count("rhat").alias("_n")
    )
    return grouped.select(
        "week_end", "symbol", "forward_return", F.transform("_f", lambda s: s["rhat"]).alias("x"),
        ((F.col("_n") == len(signals)) & F.col("forward_return").isNotNull()).alias("complete"),
    )


_PARTIAL = T.StructType([
    T.StructField("week_end", T.DateType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType()),
])


def _partial_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and week, the sums of products of (1, x..., y) over complete rows."""
    for batch in batches:
        for week, rows in batch.groupby("week_end"):
            x = np.array(rows["x"].tolist(), dtype=float)
            m = np.column_stack([np.ones(len(rows)), x, rows["forward_return"].to_numpy(dtype=float)])
            flat = (m.T @ m)[np.triu_indices(m.shape[1])]
            yield pd.DataFrame({"week_end": week, "pos": np.arange(len(flat), dtype=np.int32), "value": flat})


def weekly_moments(cases: DataFrame) -> DataFrame:
    """Sums of products per week over complete cases, as (week_end, pos, value).

    `pos` runs over the upper triangle of the product matrix of (1, x..., y). Rows are folded into one
    matrix per batch and week before anything is shuffled.
    """
    rows = cases.filter("complete").select("week_end", "x", "forward_return")
    return rows.mapInPandas(_partial_grams, _PARTIAL).groupBy("week_end", "pos").agg(F.sum("value").alias("value"))


def pooled_moments(cases: DataFrame, window: int, n_signals: int = len(SIGNALS)) -> DataFrame:
    """For every week the product sums over the previous `window` weeks present, as arrays.

    Weeks without a complete case count as weeks; the pool must be `window` weeks long and hold three rows.
    """
    weeks = cases.select("week_end").distinct().withColumn("_all", F.lit(1))
    weeks = weeks.withColumn("_w", F.row_number().over(over(["_all"], "week_end"))).select("week_end", "_w")
    moments = weekly_moments(cases)
    size = n_signals + 2
    blank = weeks.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size * (size + 1) // 2 - 1)))).withColumn("value", F.lit(0.0))
    filled = moments.join(weeks, "week_end").select("week_end", "_w", "pos", "value").unionByName(blank)
    weekly = filled.groupBy("week_end", "_w", "pos").agg(F.sum("value").alias("value"))
    past = over(["pos"], "_w").rowsBetween(-window, -1)
    pooled = weekly.withColumn("_pooled", F.sum("value").over(past)).filter(F.col("_w") > window)
    sums = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_pooled"))), lambda s: s["_pooled"])
    return pooled.groupBy("week_end").agg(sums.alias("sums")).filter(F.col("sums")[0] >= 3)


def _sparse_minimum(h: np.ndarray, xy: np.ndarray, l1: float, w: np.ndarray) -> np.ndarray:
    """Minimum of w'hw/2 - xy'w + l1*|w| by searching over signs (Lee, Battle, Raina and Ng 2007).

    With the signs of the active columns fixed the minimum is one small linear solve; a step that would
    flip a sign stops at the best zero crossing. Exact, and a few solves when started from a neighbour; a search
    that does not end is an error, never an unfinished answer.
    """
    w = w.copy()
    signs = np.sign(w)
    for _ in range(MAX_STEPS):
        slope = h @ w - xy
        active = signs != 0
        if not active.any() or np.max(np.abs(slope[active] + l1 * signs[active])) <= SLACK * l1:
            idle = np.where(active, 0.0, np.abs(slope))
            j = int(np.argmax(idle))
            if idle[j] <= l1 * (1.0 + SLACK):
                break
            signs[j] = -np.sign(slope[j])
            active[j] = True
        on = np.flatnonzero(active)
        goal = np.linalg.solve(h[np.ix_(on, on)], xy[on] - l1 * signs[on])
        here = w[on]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossings = here / (here - goal)
        cuts = np.concatenate([crossings[(crossings > 0.0) & (crossings < 1.0)], [1.0]])
        points = here + cuts[:, None] * (goal - here)
        points[np.abs(points) < 1e-15 * np.max(np.abs(points))] = 0.0
        sub = h[np.ix_(on, on)]
        cost = 0.5 * np.einsum("ij,jk,ik->i", points, sub, points) - points @ xy[on] + l1 * np.abs(points).sum(axis=1)
        w[on] = points[int(np.argmin(cost))]
        signs = np.sign(w)
    else:
        raise ArithmeticError(f"sign search did not end within {MAX_STEPS} steps")
    return w


def elastic_net_path(n: float, gram: np.ndarray, xy: np.ndarray, yy: float, l1_ratio: float = L1_RATIO) -> tuple[int, list[float], float, np.ndarray]:
    """The information-criterion-best point of an elastic-net path: its number, every point's criterion, its penalty and weights.

    Works on sums of products of centred, scaled columns. The path runs over falling penalties with warm
    starts; its point is chosen by the small-sample Akaike criterion with two parameters besides the
    non-zero weights. Without a column that moves with the target there is no path: number -1, weights 0.
    """
    p = len(xy)
    top = np.max(np.abs(xy)) / (n * l1_ratio)
    w = np.zeros(p)
    if not np.isfinite(top) or top <= 0:
        return -1, [], 0.0, w
    best, chosen, scores = np.inf, (-1, 0.0, w), []
    for i, penalty in enumerate(np.geomspace(top, top * PATH_RATIO, N_PENALTIES)):
        ridge = penalty * (1.0 - l1_ratio) * n
        w = _sparse_minimum(gram + ridge * np.eye(p), xy, penalty * l1_ratio * n, w)
        rss = yy - 2.0 * xy @ w + w @ gram @ w
        k = int(np.count_nonzero(np.abs(w) > SELECTED_ABOVE)) + 2
        score = np.inf
        if n - k - 1 > 0:
            score = -np.inf if rss <= 0 else n * np.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        scores.append(float(score))
        if score < best:
            best, chosen = score, (i, float(penalty), w)
    return chosen[0], scores, chosen[1], chosen[2]


def elastic_net_selection(n: float, gram: np.ndarray, xy: np.ndarray, yy: float, l1_ratio: float = L1_RATIO) -> np.ndarray:
    """Positive-weight columns of the chosen point of `elastic_net_path`."""
    return elastic_net_path(n, gram, xy, yy, l1_ratio)[3] > SELECTED_ABOVE


_PATH = T.StructType([
    T.StructField("point", T.IntegerType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("penalty", T.DoubleType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(_PATH)
def _solved(sums: pd.Series) -> pd.DataFrame:
    out = []
    for flat in sums:
        size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = flat
        full = full + np.triu(full, 1).T
        n, total = full[0, 0], full[0, 1:]
        centred = full[1:, 1:] - np.outer(total, total) / n
        gram, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
        spread = np.sqrt(np.clip(np.diag(gram), 0, None) / n)
        spread[spread < FLAT * np.sqrt(np.diag(full)[1:-1] / n)] = 1.0
        out.append(elastic_net_path(n, gram / np.outer(spread, spread), xy / spread, yy))
    return pd.DataFrame(out, columns=["point", "scores", "penalty", "weights"])


def solve_paths(pooled: DataFrame) -> DataFrame:
    """Every week's product sums with the chosen point of its path (`path`)."""
    return pooled.withColumn("path", _solved("sums"))


def select_signals(pooled: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """The signals kept in each week, one row per kept signal."""
    names = F.array(*[F.lit(s) for s in signals])
    kept = solve_paths(pooled).select("week_end", F.explode(F.arrays_zip(names.alias("signal"), F.col("path.weights").alias("weight"))).alias("_s"))
    return kept.filter(F.col("_s.weight") > SELECTED_ABOVE).select("week_end", F.col("_s.signal").alias("signal"))


def certify_paths(solved: DataFrame, n_signals: int = len(SIGNALS), l1_ratio: float = L1_RATIO, slack: float = 1e-6) -> DataFrame:
    """Checks each week's chosen point against the product sums, without the solver: rows (week_end, pool_rows, n_points,
    optimal, best).

    At the minimum the slope of every weight that is not 0 equals the penalty with the opposite sign, and no other slope
    exceeds it (`optimal`, to a part `slack` of the penalty). The criterion worked out from the sums is the one stated for
    the point, and the smallest of the path (`best`).
    """
    size, places = n_signals + 2, F.sequence(F.lit(1), F.lit(n_signals))

    def raw(i: Column, j: Column) -> Column:
        a, b = F.least(i, j), F.greatest(i, j)
        return F.get("sums", (a * size - F.floor(a * (a - 1) / 2) + b - a).cast("int"))

    n = F.get("sums", 0)

    def centred(i: Column, j: Column) -> Column:
        return raw(i, j) - raw(F.lit(0), i) * raw(F.lit(0), j) / n

    def spread(i: Column) -> Column:
        own = F.sqrt(F.greatest(centred(i, i), F.lit(0.0)) / n)
        return F.when(own < FLAT * F.sqrt(raw(i, i) / n), 1.0).otherwise(own)

    rows = solved.select("week_end", "sums", "path", F.transform(places, spread).alias("s"))
    y = F.lit(n_signals + 1)
    rows = rows.withColumns({
        "xy": F.transform(places, lambda i: centred(i, y) / F.get("s", i - 1)),
        "gw": F.transform(places, lambda i: F.aggregate(places, F.lit(0.0), lambda acc, k: acc + centred(i, k) / (F.get("s", i - 1) * F.get("s", k - 1)) * F.get("path.weights", k - 1))),
        "l1": F.col("path.penalty") * l1_ratio * n, "ridge": F.col("path.penalty") * (1.0 - l1_ratio) * n,
    })
    w = lambda i: F.get("path.weights", i - 1)
    slope = lambda i: F.get("gw", i - 1) + F.col("ridge") * w(i) - F.get("xy", i - 1)
    off = F.transform(places, lambda i: F.when(w(i) != 0, F.abs(slope(i) + F.col("l1") * F.signum(w(i)))).otherwise(F.greatest(F.abs(slope(i)) - F.col("l1"), F.lit(0.0))))
    total = lambda f: F.aggregate(places, F.lit(0.0), lambda acc, i: acc + f(i))
    rss = centred(y, y) - 2.0 * total(lambda i: F.get("xy", i - 1) * w(i)) + total(lambda i: F.get("gw", i - 1) * w(i))
    k = F.size(F.filter("path.weights", lambda x: F.abs(x) > SELECTED_ABOVE)) + 2
    score = n * F.ln(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    stated = F.get("path.scores", F.col("path.point"))
    best = (F.col("path.point") < 0) | ((F.abs(score - stated) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(stated))) & (stated == F.array_min("path.scores")))
    return rows.select("week_end", n.alias("pool_rows"), F.size("path.scores").alias("n_points"), (F.array_max(off) <= slack * F.col("l1")).alias("optimal"), best.alias("best"))


def combine(long: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Mean of the selected forecasts (of all, without a selection) of every (week, symbol); rows without one are dropped."""
    joined = long if selected is None else long.join(selected, ["week_end", "signal"], "left_semi")
    mean = joined.groupBy("week_end", "symbol").agg(F.avg("rhat").alias("score"), F.first("forward_return").alias("forward_return"))
    return mean.filter("score IS NOT NULL")


def assign_buckets(scored: DataFrame, n_buckets: int = 5) -> DataFrame:
    """Equal-count buckets per week, 0 lowest; ties go by symbol; weeks with too few names are dropped."""
    rank = F.row_number().over(over(["week_end"], "score", "symbol")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("week_end"))
    ranked = scored.withColumn("_rank", rank).withColumn("_n", n).filter(F.col("_n") >= n_buckets)
    bucket = F.least(F.floor(F.col("_rank") * n_buckets / F.col("_n")), F.lit(n_buckets - 1)).cast("int")
    return ranked.withColumn("bucket", bucket).drop("_rank", "_n")


def signal_frame(daily_features_weekly: DataFrame, flagged: DataFrame) -> DataFrame:
    """Eligible (week, symbol) pairs with their forward return and weekly signals."""
    eligible = flagged.filter("eligible").select("week_end", "symbol", "forward_return")
    return eligible.join(daily_features_weekly, ["week_end", "symbol"], "left")


def cross_sectional_forecasts(
    frame: DataFrame, window: int = 52, n_buckets: int = 5, signals: Sequence[str] = SIGNALS
) -> DataFrame:
    """From weekly signals to bucketed scores: rank, regress, smooth, forecast, select, combine, bucket."""
    ranked = stage(rank_map(long_signals(frame, signals)), "ranked")  # the regressions and the forecasts read it
    long = forecasts(ranked, smooth_coefficients(weekly_regressions(ranked), window))
    selected = select_signals(pooled_moments(complete_cases(long, signals), window, len(signals)), signals)
    return assign_buckets(combine(long, selected), n_buckets)


def rank_ic(scored: DataFrame) -> DataFrame:
    """Weekly rank correlation of score and forward return over names with both; weeks of three or more."""
    both = scored.filter("score IS NOT NULL AND forward_return IS NOT NULL")
    ranked = both.withColumn("_a", average_rank("score", ["week_end"])).withColumn("_b", average_rank("forward_return", ["week_end"]))
    agg = ranked.groupBy("week_end").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_a").alias("_va"), F.var_pop("_b").alias("_vb"), F.corr("_a", "_b").alias("ic")
    )
    return agg.filter("n >= 3 AND _va > 0 AND _vb > 0").select("week_end", "n", "ic")


def ic_summary(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, t-ratio on the population deviation, and share positive of the weekly correlations."""
    agg = weekly.groupBy(*keys).agg(
        F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_weeks"), F.stddev_pop("ic").alias("_sd"),
        F.avg((F.col("ic") > 0).cast("double")).alias("frac_positive"),
    )
    t = F.when(F.col("_sd") > 0, F.col("mean_ic") / (F.col("_sd") / F.sqrt("n_weeks"))).otherwise(0.0)
    return agg.withColumn("ic_t_stat", t).drop("_sd")


def bucket_returns(bucketed: DataFrame, n_buckets: int = 5) -> DataFrame:
    """Mean forward return per bucket, zero for an empty one, and each bucket's excess over the lowest."""
    means = bucketed.filter("forward_return IS NOT NULL").groupBy("bucket").agg(F.avg("forward_return").alias("mean_forward"))
    every = bucketed.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(means, "bucket", "left").withColumn("mean_forward", F.coalesce("mean_forward", F.lit(0.0)))
    low = F.max(F.when(F.col("bucket") == 0, F.col("mean_forward"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("over_lowest", F.col("mean_forward") - low)


def portfolio_variants(taker_cost: float, maker_cost: float) -> list[dict[str, object]]:
    """All combinations of portfolio kind, execution style and treatment of missing returns."""
    return [
        {"portfolio": kind, "execution": style, "missing_policy": policy, "one_side_cost": cost}
        for kind in ("long_only_top", "long_short_top_minus_bottom")
        for style, cost in (("taker", taker_cost), ("maker", maker_cost))
        for policy in ("delisting_loss", "drop_and_renormalize")
    ]


VARIANT = ("portfolio", "execution", "missing_policy")


def bucket_portfolios(
    bucketed: DataFrame, variants: Sequence[dict[str, object]], n_buckets: int = 5, missing_loss: float = -1.0
) -> DataFrame:
    """Weekly return, turnover and cost of every portfolio variant in one job.

    A missing forward return is a total loss, or its name is dropped before weighting. Turnover is
    measured against the weights of the last scored week, without the names that lost their data. Execution
    changes the cost alone, so books are formed without it.
    """
    keys = [c for c in VARIANT if c != "execution"]
    books = list({tuple(v[k] for k in keys): {k: v[k] for k in keys} for v in variants}.values())
    top, missing = F.col("bucket") == n_buckets - 1, F.col("forward_return").isNull()
    short = F.col("portfolio") == "long_short_top_minus_bottom"
    rows = with_grid(bucketed.select("week_end", "symbol", "bucket", "forward_return"), books)
    rows = rows.filter(top | (short & (F.col("bucket") == 0))).filter(~(missing & (F.col("missing_policy") == "drop_and_renormalize")))
    week = Window.partitionBy(*keys, "week_end")
    rows = rows.withColumns({
        "_long": F.count_if(top).over(week), "_short": F.count_if(~top).over(week), "_known": F.count("forward_return").over(week),
    }).filter((F.col("_known") > 0) & (F.col("_long") > 0) & (~short | (F.col("_short") > 0)))
    weight = F.when(~short, 1.0 / F.col("_long")).when(top, 0.5 / F.col("_long")).otherwise(-0.5 / F.nullif(F.col("_short"), F.lit(0)))
    held = rows.withColumn("weight", weight)
    weeks = held.select(*keys, "week_end").distinct().withColumn("_no", F.row_number().over(over(keys, "week_end")))
    held = held.join(weeks, [*keys, "week_end"])
    book = held.select(*keys, "symbol", "_no", "weight", F.lit(0.0).alias("before"))
    carried = held.filter(~missing).select(*keys, "symbol", (F.col("_no") + 1).alias("_no"), F.lit(0.0).alias("weight"), F.col("weight").alias("before"))
    moves = book.unionByName(carried).groupBy(*keys, "_no", "symbol").agg(F.sum("weight").alias("weight"), F.sum("before").alias("before"))
    turnover = moves.groupBy(*keys, "_no").agg(F.sum(F.abs(F.col("weight") - F.col("before"))).alias("turnover"))
    gross = held.groupBy(*keys, "week_end", "_no").agg(
        F.sum(F.col("weight") * F.coalesce("forward_return", F.lit(missing_loss))).alias("gross_return"),
        F.count_if(top).alias("n_long"), F.count_if(~top).alias("n_short"), F.count_if(missing).alias("n_missing"),
    )
    priced = F.array(*[F.struct(*[F.lit(v[k]).alias(k) for k in (*VARIANT, "one_side_cost")]) for v in variants])
    own = F.filter(priced, lambda v: all_of([v[k] == F.col(k) for k in keys]))
    out = gross.join(turnover, [*keys, "_no"]).withColumn("_v", F.explode(own)).withColumns({"execution": F.col("_v.execution"), "cost": F.col("turnover") * F.col("_v.one_side_cost")})
    return out.withColumn("net_return", F.col("gross_return") - F.col("cost")).withColumnRenamed("_no", "week_no").drop("_v")
