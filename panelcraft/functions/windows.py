"""Window shapes, full-window guards, average ranks, literal grids and hash draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def over(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*order) if order else spec


def trailing(keys: Sequence[str], order: Column | str, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return over(keys, order).rowsBetween(-(n - 1), 0)


def running(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    return over(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def when_full(value: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A windowed value, NULL until n non-null observations are in the frame."""
    return F.when(F.count(counted).over(w) == n, value)


_ROLL = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}


def rolling(col: Column | str, op: str, keys: Sequence[str], order: Column | str, n: int) -> Column:
    """Trailing mean, min, max, sum or population deviation, NULL until the window is full."""
    c = F.col(col) if isinstance(col, str) else col
    w = trailing(keys, order, n)
    return when_full(_ROLL[op](c).over(w), c, w, n)


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """1-based rank with ties sharing their mean rank; NULL for a NULL value."""
    present = F.col(value).isNull()
    ranked = Window.partitionBy(*keys, present).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.when(~present, F.rank().over(ranked) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def with_grid(df: DataFrame, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Repeat every row once per entry of a short constant table, adding the entry's columns.

    The table travels inside the plan as literals: no join, no shuffle.
    """
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return df.withColumn("_grid", F.explode(F.array(*structs))).select(
        *df.columns, *[F.col(f"_grid.{k}").alias(k) for k in rows[0]]
    )


def uniform(*parts: Column | str | int) -> Column:
    """A uniform draw in [0, 1) that depends only on its key parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
