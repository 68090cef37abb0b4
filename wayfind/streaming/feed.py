"""The change feed as a stream: each micro-batch of documents with actions makes the next version of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfind.config import EngineConfig
from wayfind.operators.index import Index, apply_changes, build
from wayfind.sources.readers import from_json
from wayfind.sources.store import latest


def _done(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(x[1:]) for x in found if x.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/filters/_SUCCESS")))


def current(spark: SparkSession, path: str) -> Index | None:
    """The last whole version."""
    found = _done(spark, path)
    return Index.read(spark, f"{path}/v{found[-1]}") if found else None


def apply_feed(lines: DataFrame, path: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Start a query that applies a stream of JSON lines (column value) to the index under `path`.

    A batch's version is named by its number and written whole before it counts, so a batch that runs again after a
    failure writes the same version again. Within a batch the change of a document that came last counts, lines being in order of their arrival column, else as the source gives them.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _done(spark, path) if v < number]
        if "arrival" not in batch.columns:
            batch = batch.withColumn("arrival", F.monotonically_increasing_id())
        changes = from_json(batch, config)
        if before:
            index = apply_changes(Index.read(spark, f"{path}/v{before[-1]}"), changes, config)
        else:
            index = build(latest(changes).where(F.coalesce("action", F.lit("index")) != "delete"), config)
        index.write(f"{path}/v{number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
