"""Purged splits of time-ordered series: folds, walk-forward, combinatorial splits and their paths.

Group borders follow from a row's position and the series length alone, so roles are assigned row by
row; only a handful of border rows per series is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.windows import any_of, over, with_grid
from .returns import KEY


def fold_of(idx: Column, n: Column, k: int) -> Column:
    """Fold number of a position when the first `n mod k` folds take one extra row."""
    base, extra = F.floor(n / F.lit(k)), n % k
    head = extra * (base + 1)
    late = extra + F.floor((idx - head) / F.greatest(base, F.lit(1)))
    return F.when(idx < head, F.floor(idx / (base + 1))).otherwise(late).cast("int")


def fold_start(fold: Column, n: Column, k: int) -> Column:
    """First position of a fold."""
    return fold * F.floor(n / F.lit(k)) + F.least(fold, n % k)


def contiguous_folds(series: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return series.join(sizes, list(keys)).withColumn("fold", fold_of(F.col("idx"), F.col("_n"), k)).drop("_n")


def embargo_share(n: Column, horizon: int, least: float = 0.05) -> Column:
    """Embargo as a share of the rows, wide enough to cover the holding horizon; raises if nothing is left."""
    pct = F.greatest(F.lit(least), (horizon + 0.5) / n)
    return F.when(pct < 1.0, pct).otherwise(F.raise_error(F.lit("embargo leaves no training rows")))


def event_horizons(obs: DataFrame, horizon: int, keys: Sequence[str] = KEY, dt: str = "dt") -> DataFrame:
    """Label end of each row: the instant `horizon` rows later; the rows without one are dropped."""
    return obs.withColumn("horizon", F.lead(dt, horizon).over(over(keys, "idx"))).filter("horizon IS NOT NULL")


def clipped_horizons(obs: DataFrame, rows: int, keys: Sequence[str] = KEY, dt: str = "dt") -> DataFrame:
    """Label end `rows` rows later, or the series end where fewer remain."""
    ahead = F.lead(dt, rows).over(over(keys, "idx"))
    return obs.withColumn("horizon", F.coalesce(ahead, F.max(dt).over(over(keys))))


def fixed_horizons(obs: DataFrame, days: int, dt: str = "dt") -> DataFrame:
    """Label end a fixed number of days later."""
    return obs.withColumn("horizon", F.date_add(dt, days))


def horizon_spans(labelled: DataFrame, horizon: int, keys: Sequence[str], interval: str = "interval_hours") -> DataFrame:
    """Longest real span of a label in hours against its nominal span."""
    hours = (F.unix_micros(F.col("horizon").cast("timestamp")) - F.unix_micros(F.col("dt").cast("timestamp"))) / 3.6e9
    out = labelled.groupBy(*keys).agg(
        F.max(hours).alias("max_span_hours"),
        (F.mode(interval, True).cast("double") * horizon).alias("nominal_span_hours"),
    )
    return out.withColumn("span_ratio", F.col("max_span_hours") / F.nullif(F.col("nominal_span_hours"), F.lit(0.0)))


def _borders(labels: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Per series: length and the first and last instant and position of each fold, as k-element arrays.

    A series with fewer rows than folds raises; `short_series` lists them.
    """
    sizes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fold = fold_of(F.col("idx"), F.col("n"), k)
    per_fold = (
        labels.join(sizes, list(keys)).groupBy(*keys, "n", fold.alias("_fold"))
        .agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.max("idx").alias("end"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_fold", "first", "last", "end")))
    short = F.raise_error(F.concat(F.lit(f"fewer than {k} rows in series "), F.concat_ws("/", *[F.col(c).cast("string") for c in keys])))
    checked = F.when(F.col("n") >= k, F.col("n")).otherwise(short.cast("bigint"))
    return per_fold.groupBy(*keys, "n").agg(ordered.alias("_borders")).withColumn("n", checked)


def short_series(series: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Series with fewer rows than folds, which cannot be split: id and length."""
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k)


def _with_roles(
    labels: DataFrame, combos: Sequence[Sequence[int]], k: int, keys: Sequence[str], embargo: Column
) -> DataFrame:
    size = len(combos[0])
    grid = [
        {"split_id": i, **{f"_g{j}": g for j, g in enumerate(combo)}} for i, combo in enumerate(combos)
    ]
    rows = labels.join(_borders(labels, k, keys), list(keys)).withColumn("group", fold_of(F.col("idx"), F.col("n"), k))
    rows = with_grid(rows.withColumn("_embargo", F.floor(F.col("n") * embargo)), grid)
    blocks = [F.get("_borders", F.col(f"_g{j}")) for j in range(size)]
    test = any_of([F.col("group") == F.col(f"_g{j}") for j in range(size)])
    purged = any_of([(F.col("dt") <= b["last"]) & (F.col("horizon") >= b["first"]) for b in blocks])
    held = any_of([(F.col("idx") > b["end"]) & (F.col("idx") <= b["end"] + F.col("_embargo")) for b in blocks])
    role = F.when(test, "test").when(purged, "purged").when(held, "embargo").otherwise("train")
    return rows.withColumn("role", role).select(*keys, "idx", "split_id", "group", "role")


def purged_kfold(labels: DataFrame, k: int, embargo_pct: float = 0.05, keys: Sequence[str] = KEY) -> DataFrame:
    """Role of every row in each of k folds: test, purged (label overlaps the block), embargo or train."""
    return _with_roles(labels, [(g,) for g in range(k)], k, keys, F.lit(embargo_pct))


def combinatorial_splits(
    labels: DataFrame, n_groups: int = 6, k_test: int = 2, horizon: int | None = None,
    embargo_pct: float = 0.05, keys: Sequence[str] = KEY,
) -> DataFrame:
    """Role of every row in each choice of `k_test` test groups out of `n_groups`.

    With a horizon the embargo is widened to cover it.
    """
    embargo = F.lit(embargo_pct) if horizon is None else embargo_share(F.col("n"), horizon, embargo_pct)
    return _with_roles(labels, list(combinations(range(n_groups), k_test)), n_groups, keys, embargo)


def walk_forward(obs: DataFrame, train_end: str, test_start: str, dt: str = "dt") -> DataFrame:
    """Training rows strictly before one instant, test rows from another on."""
    role = F.when(F.col(dt) < F.lit(train_end).cast("date"), "train").when(F.col(dt) >= F.lit(test_start).cast("date"), "test")
    return obs.withColumn("role", role).filter("role IS NOT NULL")


def path_table(n_groups: int, k_test: int) -> list[dict[str, int]]:
    """Which split supplies each group on each path: path j takes the j-th split that tests the group."""
    combos = list(combinations(range(n_groups), k_test))
    testing = {g: [i for i, c in enumerate(combos) if g in c] for g in range(n_groups)}
    return [
        {"path": j, "group": g, "split_id": split} for g, splits in testing.items() for j, split in enumerate(splits)
    ]


def split_paths(series: DataFrame, n_groups: int = 6, k_test: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """Every full-length path through the splits, as rows (path, idx, split_id)."""
    folded = contiguous_folds(series, n_groups, keys).withColumnRenamed("fold", "group")
    per_group: dict[int, list[dict[str, int]]] = {}
    for row in path_table(n_groups, k_test):
        per_group.setdefault(row["group"], []).append(row)
    choices = F.array(*[
        F.array(*[F.struct(F.lit(r["path"]).alias("path"), F.lit(r["split_id"]).alias("split_id")) for r in per_group[g]])
        for g in range(n_groups)
    ])
    return folded.withColumn("_p", F.explode(F.get(choices, F.col("group")))).select(
        *keys, "idx", "group", "ret", "_p.path", "_p.split_id"
    )


def test_series(series: DataFrame, n_groups: int = 6, k_test: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """The test rows of every combinatorial split, joined end to end and renumbered, keyed by split.

    The new position is arithmetic on group borders, so no sort is needed. Series with fewer rows than groups have no
    split (`short_series` lists them).
    """
    combos = list(combinations(range(n_groups), k_test))
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n_groups)
    rows = series.join(sizes, list(keys)).withColumn("_g", fold_of(F.col("idx"), F.col("_n"), n_groups))
    member = F.array(*[
        F.array(*[
            F.struct(F.lit(i).alias("split_id"), F.array(*[F.lit(h) for h in c if h < g]).cast("array<int>").alias("earlier"))
            for i, c in enumerate(combos) if g in c
        ])
        for g in range(n_groups)
    ])
    start = fold_start(F.col("_g"), F.col("_n"), n_groups)
    size = lambda g: fold_start(g + 1, F.col("_n"), n_groups) - fold_start(g, F.col("_n"), n_groups)
    before = F.aggregate("_m.earlier", F.lit(0).cast("bigint"), lambda a, g: a + size(g))
    return (
        rows.withColumn("_m", F.explode(F.get(member, F.col("_g"))))
        .withColumn("_idx", F.col("idx") - start + before)
        .select(*keys, "_m.split_id", F.col("_idx").alias("idx"), *[c for c in ("dt", "ret") if c in series.columns])
    )
