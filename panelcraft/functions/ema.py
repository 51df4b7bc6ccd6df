"""Recursive exponential averages with window functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from .windows import over


class Ema(NamedTuple):
    """An average of `column` with weight `alpha`, NULL until `min_obs` values have been seen."""

    column: str
    alpha: float
    min_obs: int = 1


def span(column: str, n: int) -> Ema:
    return Ema(column, 2.0 / (n + 1.0), n)


def wilder(column: str, n: int) -> Ema:
    return Ema(column, 1.0 / n, n)


def with_ema(df: DataFrame, specs: Mapping[str, Ema], keys: Sequence[str], order: str) -> DataFrame:
    """Add y[t] = (1 - a) * y[t-1] + a * x[t], y[0] = x[0], per key in `order`; NULL inputs are skipped.

    The recursion is a geometrically weighted running sum. Positions are cut into chunks long enough
    that a value two chunks back weighs less than double precision can show, so a running sum inside
    the chunk plus the end of the chunk before gives the recursion to the last digits, and weights
    never overflow. Everything runs on one partitioning by key.
    """
    chunk = 1 << math.ceil(math.log2(40.0 / -math.log1p(-min(s.alpha for s in specs.values()))))
    every = over(keys, order)
    so_far = every.rowsBetween(Window.unboundedPreceding, 0)
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    columns = {s.column for s in specs.values()}
    out = df.withColumns({f"_pos_{c}": F.count(c).over(so_far) - 1 for c in columns})
    out = out.withColumns({f"_chunk_{c}": F.floor(F.col(f"_pos_{c}") / chunk) for c in columns})
    local = {}
    for name, s in specs.items():
        pos, step = F.col(f"_pos_{s.column}"), F.pmod(F.col(f"_pos_{s.column}"), F.lit(chunk))
        keep = F.lit(1.0 - s.alpha)
        weight = F.when(pos == 0, 1.0).otherwise(s.alpha) * F.pow(keep, -step.cast("double"))
        inside = Window.partitionBy(*keys, f"_chunk_{s.column}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        local[f"_sum_{name}"] = F.sum(F.col(s.column) * weight).over(inside) * F.pow(keep, step.cast("double"))
    out = out.withColumns(local)
    done = {}
    for name, s in specs.items():
        x, pos = F.col(s.column), F.col(f"_pos_{s.column}")
        step = F.pmod(pos, F.lit(chunk))
        at_end = F.when(x.isNotNull() & (step == chunk - 1), F.col(f"_sum_{name}"))
        before = F.coalesce(F.last(at_end, ignorenulls=True).over(earlier), F.lit(0.0))
        value = F.col(f"_sum_{name}") + before * F.pow(F.lit(1.0 - s.alpha), (step + 1).cast("double"))
        done[name] = F.when(x.isNotNull() & (pos + 1 >= s.min_obs), value)
    helpers = [c for c in out.columns if c.startswith(("_pos_", "_chunk_", "_sum_"))]
    return out.withColumns(done).drop(*helpers)
