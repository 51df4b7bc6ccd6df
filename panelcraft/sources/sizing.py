"""Writes whose tasks hold a bounded number of rows, whatever share of them one key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Rows that one write task takes, about.
ROWS_PER_TASK = 1_000_000


def sized_tasks(df: DataFrame, partition: str, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """`df` with the task each row should go to (`_task`) and the piece of its key (`_piece`); each key's first task and pieces.

    The rows of every key are counted first, with map-side combine. A key with more rows than a task takes gets tasks of
    its own, as many as it fills; keys with fewer share tasks until one is full. A row's piece is a hash of its columns and
    of the input split it comes from, so copies of one row are dealt out too. Keys are folders, so their counts may
    come to the driver.
    """
    counts = sorted((r["n"], r["k"]) for r in df.groupBy(F.col(partition).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    plan, task, filled = [], 0, 0
    for n, key in counts:
        pieces = -(-n // rows_per_task)
        if filled and (filled + n > rows_per_task or pieces > 1):
            task, filled = task + 1, 0
        plan.append((key, task, pieces))
        if pieces > 1:
            task, filled = task + pieces, 0
        else:
            filled += n
    tasks = df.sparkSession.createDataFrame(plan, "_key string, _first int, _pieces int")
    split = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])
    joined = df.withColumn("_split", split).join(F.broadcast(tasks), F.col(partition).cast("string").eqNullSafe(F.col("_key")))  # a row per folder
    piece = F.pmod(F.col("_split"), F.col("_pieces").cast("long")).cast("int")
    return joined.select(*df.columns, piece.alias("_piece"), (F.col("_first") + piece).alias("_task")), plan


def n_tasks(plan: list[tuple[str, int, int]]) -> int:
    return max((first + pieces for _, first, pieces in plan), default=1)


def sized(df: DataFrame, partition: str, rows_per_task: int = ROWS_PER_TASK, order: Sequence[str] = ()) -> DataFrame:
    """`df` dealt to tasks by `sized_tasks`, each sorted by the partition column and `order`."""
    rows, plan = sized_tasks(df, partition, rows_per_task)
    return rows.repartitionById(n_tasks(plan), F.col("_task")).sortWithinPartitions(partition, *order).drop("_task", "_piece")
