"""Looking into an index: what the interactive commands of a search shell show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.config import EngineConfig
from wayfind.functions import geo, text
from wayfind.operators import retrieve
from wayfind.operators.index import Index


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def frequency(index: Index, *tokens: str) -> DataFrame:
    return index.token_stats.where(F.col("token").isin(*tokens)).select("token", "df")


def best_score(index: Index, token: str, rows: int = 21) -> DataFrame:
    return index.postings.where(F.col("token") == token).orderBy(F.desc("boost"), "doc_id").limit(rows).select("doc_id", "boost")


def index_rank(index: Index, doc_id: str | None = None) -> DataFrame:
    """Each token of a document (null: of all) with its boost and the document's rank among the token's."""
    ranked = index.postings.withColumn("rank", F.rank().over(Window.partitionBy("token").orderBy(F.desc("boost"))))
    if doc_id is not None:
        own = index.postings.where(F.col("doc_id") == doc_id).select("token")
        ranked = ranked.join(own, "token", "left_semi").where(F.col("doc_id") == doc_id)
    return ranked.select("token", "doc_id", "boost", "rank")


def pair(index: Index, token: str) -> DataFrame:
    return index.pairs.where(F.col("token") == token).select("other").orderBy("other")


def autocomplete(index: Index, prefix: str) -> DataFrame:
    return index.edge_ngrams.where(F.col("prefix") == prefix).select("token")


def fuzzy(spark: SparkSession, word: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return _one(spark, word=word).select(F.posexplode(text.fuzzy_neighbors(F.col("word"), config)).alias("rank", "neighbor"))


def fuzzy_index(index: Index, word: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Neighbours of a word that are in the index, most frequent first."""
    near = fuzzy(index.token_stats.sparkSession, word, config).select(F.col("neighbor").alias("token"))
    return index.token_stats.join(near, "token", "left_semi").select("token", "df").orderBy(F.desc("df"), "token")


def intersect(index: Index, tokens: list[str], limit: int = 100) -> DataFrame:
    """Documents with all tokens and the sum of their boosts; one more than the limit."""
    spark = index.postings.sparkSession
    a = _one(spark, query_id=0, no=0, geo=False, cap=limit + 1).select("*", F.array(*map(F.lit, tokens)).alias("toks"), F.array().cast("array<array<string>>").alias("fl"))
    return retrieve.intersect(index, a).select("doc_id", "boost", "rank").orderBy("rank")


def geo_distance(index: Index, doc_id: str, lat: float, lon: float) -> DataFrame:
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(float(lat)), F.lit(float(lon)))
    return index.documents.where(F.col("doc_id") == doc_id).select("doc_id", km.alias("km"), geo.km_to_score(km).alias("score"))


def geohash_of(spark: SparkSession, lat: float, lon: float, config: EngineConfig = EngineConfig()) -> DataFrame:
    return _one(spark, lat=float(lat), lon=float(lon)).select(geo.geohash(F.col("lat"), F.col("lon"), config.geohash_precision).alias("geohash"))


def geohash_to_geojson(spark: SparkSession, lat: float, lon: float, neighbors: int = 0, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The polygon of a cell and its neighbours up to a depth."""
    p = config.geohash_precision
    box = lambda x, y: geo.cell_bbox(x, y, p)
    at = _one(spark, lat=float(lat), lon=float(lon)).select(geo.x_bin(F.col("lon"), p).alias("x"), geo.y_bin(F.col("lat"), p).alias("y"))
    low, high = box(F.col("x") - neighbors, F.col("y") - neighbors), box(F.col("x") + neighbors, F.col("y") + neighbors)
    ring = F.array(*[F.array(lon, lat) for lon, lat in ((low["west"], low["south"]), (low["west"], high["north"]), (high["east"], high["north"]), (high["east"], low["south"]), (low["west"], low["south"]))])
    return at.select(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geojson"))


def geohash_members(index: Index, geohash: str, neighbors: bool = True) -> DataFrame:
    """Documents with a cell of this geohash or, with neighbors, around it."""
    precision = len(geohash)
    at = index.geo_cells.where(F.substring("geohash", 1, precision) == geohash).select("x_bin", "y_bin").distinct()
    if neighbors:
        at = at.select(F.explode(geo.expand_bins(F.col("x_bin"), F.col("y_bin"), precision)).alias("c")).select(F.col("c.x").alias("x_bin"), F.col("c.y").alias("y_bin")).distinct()
    return index.geo_cells.join(at, ["x_bin", "y_bin"], "left_semi").select("doc_id").distinct()


def get(index: Index, doc_id: str) -> DataFrame:
    """A document, its housenumbers sorted by their leading number."""
    number = lambda e: F.coalesce(F.regexp_extract(e["key"], r"^\d+", 0).try_cast("int"), F.lit(2**31 - 1))
    order = lambda a, b: F.when(number(a) < number(b), -1).when(number(a) > number(b), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    entries = F.array_sort(F.map_entries("housenumbers"), order)
    return index.documents.where(F.col("doc_id") == doc_id).withColumn("housenumbers", entries)


def tokenize(spark: SparkSession, value: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return _one(spark, value=value).select(F.inline(text.analyze(F.col("value"), config)))


def string_distance(spark: SparkSession, left: str, right: str) -> DataFrame:
    return _one(spark, a=left, b=right).select(text.string_similarity(text.fold(F.col("a")), text.fold(F.col("b"))).alias("similarity"))


def info(index: Index) -> dict[str, int]:
    return {name: getattr(index, name).count() for name in ("documents", "postings", "token_stats", "pairs", "edge_ngrams", "geo_cells", "filters")}
