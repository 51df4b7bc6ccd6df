"""Intermediate tables of one operator run, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.stage import remove, scratch_path


class Scratch:
    """Writes tables, reads them back, and deletes those that a run has done with."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, scratch_path(spark, name)
        self.steps = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the files; this cuts lineage and survives lost executors."""
        self.steps += 1
        path = f"{self.root}/{self.steps:03d}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table.scratch_path)
