"""Factor regressions with autocorrelation-robust errors, and static tilt differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.windows import over

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")


def tilt_difference(panel: DataFrame, expense: Column | float, portfolio_ret: str = "ret") -> DataFrame:
    """Portfolio minus market, net of a daily differential expense."""
    expense = expense if isinstance(expense, Column) else F.lit(expense)
    return panel.withColumn("difference", F.col(portfolio_ret) - (F.col("mkt_rf") + F.col("rf")) - expense)


def gram(panel: DataFrame, y: Column, factors: Sequence[str] = FACTORS, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Sums of products of (1, factors..., y), upper triangle as one array per key."""
    columns = [F.lit(1.0), *[F.col(f) for f in factors], y]
    products = [columns[i] * columns[j] for i in range(len(columns)) for j in range(i, len(columns))]
    return panel.groupBy(*keys).agg(F.array(*[F.sum(p) for p in products]).alias("sums"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(sums: pd.Series) -> pd.Series:
    """Coefficients, then the first row of the inverse product matrix."""
    out = []
    for flat in sums:
        size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = flat
        full = full + np.triu(full, 1).T
        inverse = np.linalg.inv(full[:-1, :-1])
        out.append(np.concatenate([inverse @ full[:-1, -1], inverse[0]]))
    return pd.Series(out)


def factor_regression(
    panel: DataFrame, factors: Sequence[str] = FACTORS, keys: Sequence[str] = ("portfolio",), per_year: float = 252.0
) -> DataFrame:
    """Regression of portfolio excess on factors, with a Newey-West t-ratio of the intercept.

    The product sums are aggregated on the cluster; only a matrix of a few numbers per portfolio is
    inverted in Python. The intercept's variance needs one scalar per row, u = a'x e with a the first
    row of the inverse. Its Bartlett-weighted autocovariances up to lag L are the mean square of sums of u over
    all windows of L + 1 places that touch the series: differences of one running sum, for any L.
    """
    keys = list(keys)
    y = F.col("ret") - F.col("rf")
    k = len(factors) + 1
    solved = gram(panel, y, factors, keys).select(*keys, F.col("sums")[0].alias("n"), _solve("sums").alias("_s"))
    rows = panel.join(solved, keys)
    xs = [F.lit(1.0), *[F.col(f) for f in factors]]
    fit = sum((F.col("_s")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
    lever = sum((F.col("_s")[k + i] * x for i, x in enumerate(xs)), F.lit(0.0))
    rows = rows.withColumn("_u", lever * (y - fit))
    reach = F.greatest(F.lit(1), F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))).cast("int"))
    w = over(keys, "date")
    placed = rows.withColumn("lag", reach).select(
        *keys, "n", "lag", F.row_number().over(w).cast("bigint").alias("_t"),
        F.sum("_u").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    # the sum up to t opens the window that ends at t, and closes the one that ends L + 1 places later
    after = F.sequence(F.col("_t") + 1, F.col("_t") + F.col("lag"))
    ends = F.when(F.col("_t") == F.col("n"), F.concat(F.array("_t"), after)).otherwise(F.array("_t"))
    opened = placed.select(*keys, "lag", F.explode(ends).alias("_t"), "_sum")
    closed = placed.filter("_t < n").select(*keys, "lag", (F.col("_t") + F.col("lag") + 1).alias("_t"), (-F.col("_sum")).alias("_sum"))
    windows = opened.unionByName(closed).groupBy(*keys, "lag", "_t").agg(F.sum("_sum").alias("_w"))
    spread = windows.groupBy(*keys, "lag").agg((F.sum(F.col("_w") * F.col("_w")) / (F.first("lag") + 1)).alias("_v"))
    sums = spread.join(solved, keys).withColumn("n", F.col("n").cast("bigint"))
    long_run = F.col("_v")
    out = sums.withColumn("_se", F.sqrt(F.greatest(long_run, F.lit(0.0)))).select(
        *keys, "n", "lag", F.col("_s")[0].alias("alpha"), (F.col("_s")[0] * per_year).alias("alpha_ann"),
        F.when(F.col("_se") > 0, F.col("_s")[0] / F.col("_se")).otherwise(0.0).alias("alpha_t"),
        *[F.col("_s")[i + 1].alias(f"beta_{f}") for i, f in enumerate(factors)],
    )
    tilts = [f for f in factors if f != "mkt_rf"]
    best = F.greatest(*[F.col(f"beta_{f}") for f in tilts])
    dominant = F.coalesce(*[F.when((F.col(f"beta_{f}") == best) & (best > 0), F.lit(f)) for f in tilts])
    return out.withColumn("dominant_tilt", dominant)


def return_decomposition(panel: DataFrame, regression: DataFrame, factor: str = "rmw", per_year: float = 252.0) -> DataFrame:
    """Yearly raw difference, regression intercept, and the part a factor's loading explains."""
    means = tilt_difference(panel, 0.0).groupBy("portfolio").agg(F.avg("difference").alias("_d"), F.avg(factor).alias("_f"))
    return means.join(regression, "portfolio").select(
        "portfolio", (F.col("_d") * per_year).alias("raw_difference"), "alpha_ann",
        (F.col(f"beta_{factor}") * F.col("_f") * per_year).alias("factor_part"),
    )
