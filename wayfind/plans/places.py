"""A corpus of places derived from customers, nations, regions, parts and orders, and queries over it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.config import EngineConfig

#: Names come from a small vocabulary, so the threshold for common tokens is low; one for each scale of the tables.
CONFIG = EngineConfig()

PLACES = """
select cast(c.c_custkey as string) doc_id, array(lower(c.c_mktsegment)) type, array(p.p_name) name, cast(null as array<string>) street,
  array(lpad(cast(10000 + c.c_custkey % 90 as string), 5, '0')) postcode, array(n.n_name) city, array(r.r_name) context,
  greatest(c.c_acctbal, cast(0 as double)) / 10000 importance,
  cast(48 as double) + cast(c.c_custkey % 997 as double) / cast(997 as double) lat,
  cast(2 as double) + cast((c.c_custkey * 7919) % 1009 as double) / cast(1009 as double) lon, cast(null as double) fixed_score, c.c_custkey key
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
join {part} p on p.p_partkey = c.c_custkey % (select count(*) from {part})
"""


def config_for(n: int) -> EngineConfig:
    """Common tokens are those of over a tenth of n documents, and very common ones those of over a quarter."""
    return replace(CONFIG, common_threshold=max(5, n // 10), intersect_limit=max(20, n // 4))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal documents, each with its orders' keys as housenumbers around it."""
    views = {}
    for t in ("customer", "nation", "region", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"wayfind_{t}")
        views[t] = f"wayfind_{t}"
    base = spark.sql(PLACES.format(**views))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    numbers = orders.groupBy(F.col("o_custkey").alias("key"), F.expr("o_orderkey % 200 + 1").alias("number")).agg(F.min("o_orderkey").alias("o"))
    # few bytes move here, but making the maps is work: a number of tasks that goes by the input, for all cores
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    numbers = numbers.repartition(int(min(1 << 20, max(2 * spark.sparkContext.defaultParallelism, size >> 24))), "key").groupBy("key").agg(F.collect_list(F.struct("number", "o")).alias("_h"))
    rows = base.join(numbers, "key", "left")
    off = lambda h: F.lit(1e-4) * (h["o"] % 7).cast("double")
    entry = lambda h: F.struct(
        h["number"].cast("string").alias("key"),
        F.struct(h["number"].cast("string").alias("raw"), (F.col("lat") + off(h)).alias("lat"), (F.col("lon") - off(h)).alias("lon"), F.create_map().cast("map<string,string>").alias("payload")).alias("value"),
    )
    entries = F.transform(F.array_sort(F.coalesce("_h", F.array().cast("array<struct<number:bigint,o:bigint>>"))), entry)
    rows = rows.withColumn("housenumbers", F.map_from_entries(entries))
    doc = F.to_json(F.struct("doc_id", "type", "name", "postcode", "city", "context", "importance", "lat", "lon"))
    names = ("doc_id", "type", "name", "street", "postcode", "city", "context", "importance", "lat", "lon", "fixed_score", "housenumbers")
    return rows.select(*names, F.lit(None).cast("string").alias("action"), doc.alias("doc"))


def place_queries(spark: SparkSession, sf_dir: str, kind: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """A query about every place, of the given kind or of the eight in turn: plain, misspelt, cut off, with number, with filter, near a center, of common words, and with a word too many. docs: the places, if they are written already."""
    p = (places(spark, sf_dir) if docs is None else docs).select(F.col("doc_id").cast("long").alias("n"), F.get("name", F.lit(0)).alias("name"), F.get("city", F.lit(0)).alias("city"), F.get("type", F.lit(0)).alias("type"), F.get("postcode", F.lit(0)).alias("postcode"), "lat", "lon", F.get(F.map_keys("housenumbers"), F.lit(0)).alias("hn"))
    kind = (F.col("n") % 8).cast("int") if kind is None else F.lit(kind)
    both = F.concat_ws(" ", "name", "city")
    typo = F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)"), F.lit(" "), F.col("city"))
    text = (
        F.when(kind == 1, typo).when(kind == 2, F.expr("left(name, greatest(4, length(name) - 2))")).when(kind == 3, F.concat_ws(" ", "hn", "name", "city"))
        .when(kind == 6, F.split("name", " ")[0]).when(kind == 7, F.concat_ws(" ", "name", "city", F.lit("nowhere"), "postcode")).otherwise(both)
    )
    filters = F.when(kind == 4, F.create_map(F.lit("type"), F.array("type"))).otherwise(F.create_map().cast("map<string,array<string>>"))
    near = lambda c: F.when(kind == 5, F.col(c))
    return p.select(
        F.col("n").alias("query_id"), text.alias("q"), near("lat").alias("lat"), near("lon").alias("lon"), F.lit(10).alias("limit"), (kind == 2).alias("autocomplete"), F.lit(True).alias("fuzzy"), filters.alias("filters"),
    )
