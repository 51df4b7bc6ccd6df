"""Append-only table of strategy trials and the spread of their Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ("dataset_fingerprint", "strategy_family", "sr", "t_observations", "skew", "kurt", "metadata_json")


def checked_trials(trials: DataFrame) -> DataFrame:
    """Trials with finite statistics and two or more observations; anything else raises."""
    finite = F.lit(True)
    for c in ("sr", "skew", "kurt"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = F.raise_error(F.concat(F.lit("invalid trial in family "), F.col("strategy_family"))).cast("double")
    return trials.select(
        *[F.when(finite & (F.col("t_observations") >= 2), F.col("sr")).otherwise(bad).alias("sr") if c == "sr" else F.col(c) for c in COLUMNS]
    )


def record_trials(trials: DataFrame, path: str) -> None:
    """Append trials to the table, one folder per family; files already there are never touched."""
    checked_trials(trials).withColumn("recorded_at", F.current_timestamp()).write.mode("append").partitionBy("strategy_family").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def trial_spread(trials: DataFrame, effective_n: int, strict: bool = True) -> DataFrame:
    """Effective trial count and Sharpe variance per data set and family.

    The variance of a single trial is undefined: that raises (or is NULL if not strict) unless one
    effective trial is assumed, which needs no variance.
    """
    agg = trials.groupBy("dataset_fingerprint", "strategy_family").agg(F.count("sr").alias("n_trials"), F.var_samp("sr").alias("_v"))
    lone = F.lit(0.0) if effective_n == 1 else (
        F.raise_error(F.lit("one trial has no variance")).cast("double") if strict else F.lit(None).cast("double")
    )
    return agg.select(
        "dataset_fingerprint", "strategy_family", "n_trials", F.lit(effective_n).alias("n_effective"),
        F.when(F.col("n_trials") >= 2, F.col("_v")).otherwise(lone).alias("v_sr"),
    )
