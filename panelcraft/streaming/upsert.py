"""A table of merged rows that a stream keeps up to date, late rows included."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..staging import remove


@dataclass(frozen=True)
class UpsertTable:
    """Rows keyed by `keys`, merged by aggregates, in hash buckets that are rewritten only when touched.

    `merge` names each stored column and the aggregate that makes it, from a column of that name: it must give the same
    whether rows are merged all at once or in parts, in any order. Every micro-batch is reduced to one row per key, joined
    with the present rows of the buckets it touches, merged, and written as a new version of these buckets named after the
    batch. A version counts once its batch is committed, so a batch that runs again after a failure replaces what it had
    begun, and one that had been committed changes nothing. No row is ever too late. The driver handles bucket numbers only.

    `buckets` should make a bucket's rows fit a task; it is fixed when the table is made.
    """

    path: str
    keys: Sequence[str]
    merge: dict[str, Column]
    buckets: int = 64

    def _files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, spark: SparkSession, folder: str) -> list[str]:
        files, at = self._files(spark), spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def committed(self, spark: SparkSession) -> int:
        """The last batch whose rows count; -1 before the first."""
        return max(map(int, self._listed(spark, "commits")), default=-1)

    def _versions(self, spark: SparkSession, bucket: int) -> list[int]:
        return sorted(int(name.removeprefix("version=")) for name in self._listed(spark, f"rows/bucket={bucket}"))

    def _present(self, spark: SparkSession, buckets: Sequence[int], upto: int) -> list[str]:
        """Folders of the buckets' newest versions up to a batch."""
        newest = {b: max((v for v in self._versions(spark, b) if v <= upto), default=None) for b in buckets}
        return [f"{self.path}/rows/bucket={b}/version={v}" for b, v in newest.items() if v is not None]

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", *self.keys).agg(*[c.alias(n) for n, c in self.merge.items()])

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Merge one micro-batch; to be handed to `foreachBatch`."""
        spark = rows.sparkSession
        done = self.committed(spark)
        if batch <= done:
            return
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")
        fresh = self._merged(rows.select("*", bucket)).persist()
        try:
            touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most `buckets` numbers
            for b in range(self.buckets):  # what a failed run had begun
                for v in self._versions(spark, b):
                    if v > done:
                        remove(spark, f"{self.path}/rows/bucket={b}/version={v}")
            both = fresh
            if present := self._present(spark, touched, done):
                both = fresh.unionByName(spark.read.option("basePath", f"{self.path}/rows").schema(fresh.schema).parquet(*present).select(fresh.columns))
            if touched:
                out = self._merged(both).withColumn("version", F.lit(batch))
                out.write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
            self._files(spark).create(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{batch}"), True).close()
            for b in touched:  # readers may still hold the version before this one
                for v in [v for v in self._versions(spark, b) if v < batch][:-1]:
                    remove(spark, f"{self.path}/rows/bucket={b}/version={v}")
        finally:
            fresh.unpersist()

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The merged rows of all committed batches; None before the first row."""
        found = self._present(spark, range(self.buckets), self.committed(spark))
        if not found:
            return None
        return spark.read.option("basePath", f"{self.path}/rows").parquet(*found).drop("bucket", "version")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge everything that is available in a stream, batch after batch, and stop."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply)
        query.trigger(availableNow=True).start().awaitTermination()
