"""The document store: normal documents in Parquet, with upserts and removals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, order: str | None = None) -> DataFrame:
    """The last change of each id, by the order column, else by arrival where the changes have it, else that with the greatest JSON. arrival is left out of the result."""
    order = order or ("arrival" if "arrival" in changes.columns else "doc")
    w = Window.partitionBy("doc_id").orderBy(F.desc(order), F.desc("doc"))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "arrival")


def merge(stored: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Stored documents after the changes: delete removes, index, update and none put; other actions do nothing."""
    stored = stored.drop("arrival")
    last = latest(changes, order).where(F.coalesce("action", F.lit("index")).isin("delete", "update", "index"))
    puts = last.where(F.coalesce("action", F.lit("index")) != "delete").select(*stored.columns)
    return stored.join(last.select("doc_id"), "doc_id", "left_anti").select(*stored.columns).unionByName(puts)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a pattern stands for, is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


class DocumentStore:
    """A folder of Parquet versions; a change writes the next one, so readers of the last are not disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(path(self.path)) if fs.exists(path(f"{self.path}/{x.getPath().getName()}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def apply(self, changes: DataFrame, order: str | None = None) -> DataFrame:
        stored = self.read()
        if stored is None:
            stored = changes.drop("arrival").limit(0)
        at = f"{self.path}/v{len(self.versions()):06d}-{uuid.uuid4().hex[:8]}"
        merge(stored, changes, order).write.option("compression", "zstd").parquet(at)
        return self.read()

    def get(self, *ids: str) -> DataFrame:
        """Documents of these ids; missing ones are passed over."""
        return self.read().where(F.col("doc_id").isin(*ids))

    def reset(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)
