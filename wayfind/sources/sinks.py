"""Sinks: results as GeoJSON, and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import EngineConfig

#: JSON of values that count as empty, and document keys that are no property.
EMPTY = ("null", '""', "0", "0.0", "false", "[]", "{}")
HIDDEN = ("lat", "lon", "_id", "housenumbers", "_action", "_score")


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def feature(config: EngineConfig = EngineConfig()) -> Column:
    """A GeoJSON feature from a whole result row: every key of the document that holds something, the first of several values, then what the result adds."""
    keys = F.map_filter(F.from_json("doc", "map<string,variant>"), lambda k, _: ~k.isin(*HIDDEN))
    one = F.transform_values(keys, lambda _, v: F.coalesce(F.to_json(F.try_variant_get(v, "$[0]", "variant")), F.to_json(v)))
    payload = F.transform_values(F.coalesce("d_payload", F.create_map().cast("map<string,string>")), lambda _, v: _quoted(v))
    plain = F.map_zip_with(one, payload, lambda _, a, b: F.coalesce(b, a))
    plain = F.map_filter(plain, lambda _, v: v.isNotNull() & ~v.isin(*EMPTY))
    own_type = F.get("type", F.lit(0))
    name = F.get("name", F.lit(0))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    number = F.col("housenumber")
    extra = F.array(
        pair("label", _quoted(F.col("label"))), pair("score", F.col("score").cast("string")), pair("housenumber", F.when(number.isNotNull(), _quoted(number))),
        pair("type", F.when(F.col("d_type") != "", _quoted(F.col("d_type")))), pair("name", F.when(number.isNotNull(), _quoted(F.concat(number, F.lit(" "), name)))),
        pair("distance", F.when(F.col("distance").isNotNull(), F.col("distance").cast("long").cast("string"))),
    )
    extra = F.filter(extra, lambda e: e["value"].isNotNull())
    named = F.when(own_type.isNotNull() & (own_type != "") & ~F.map_contains_key(plain, own_type) & ~F.exists(extra, lambda e: e["key"] == own_type), F.array(F.struct(own_type.alias("key"), _quoted(name).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    rest = F.filter(F.map_entries(plain), lambda e: ~F.exists(extra, lambda x: x["key"] == e["key"]))
    pairs = F.concat(extra, rest, named)
    properties = F.array_join(F.transform(pairs, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), e["value"])), ", ")
    point = F.concat(F.lit('{"type": "Point", "coordinates": ['), F.col("d_lon").cast("string"), F.lit(", "), F.col("d_lat").cast("string"), F.lit("]}"))
    return F.concat(F.lit('{"type": "Feature", "geometry": '), point, F.lit(', "properties": {'), properties, F.lit("}}"))


def collections(results: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """query_id and geojson, a FeatureCollection for every query, empty ones too."""
    lists = results.select("query_id", F.struct("rank", feature(config).alias("f")).alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("fs"))
    q = queries.join(lists, "query_id", "left")
    names = set(queries.columns)
    tail = [F.concat(F.lit(', "query": '), _quoted(F.col("q")))] if "q" in names else []
    tail.append(F.when(F.size("filters") > 0, F.concat(F.lit(', "filters": '), F.to_json("filters"))))
    if "q" in names:
        tail.append(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat(F.lit(', "center": ['), F.col("lon").cast("string"), F.lit(", "), F.col("lat").cast("string"), F.lit("]"))))
    tail.append(F.when(F.col("limit").isNotNull(), F.concat(F.lit(', "limit": '), F.col("limit").cast("string"))))
    features = F.array_join(F.coalesce("fs", F.array().cast("array<string>")), ", ")
    head = F.concat(F.lit('{"type": "FeatureCollection", "version": "draft", "features": ['), features, F.lit('], "attribution": '), _quoted(F.lit(config.attribution)), F.lit(', "licence": '), _quoted(F.lit(config.licence)))
    return q.select("query_id", F.concat(head, *[F.coalesce(t, F.lit("")) for t in tail], F.lit("}")).alias("geojson"))


def query_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and line: query, first label, score with two decimals; dashes where nothing was found."""
    first = results.where("rank = 1").select("query_id", "label", F.format_string("%.2f", "score").alias("score"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return queries.join(first, "query_id", "left").select("query_id", F.concat_ws("\t", "q", dash("label"), dash("score")).alias("line"))


def not_found_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.join(results.select("query_id"), "query_id", "left_anti").select("query_id", F.col("q").alias("line"))


def slow_log(results: DataFrame, queries: DataFrame, milliseconds: int, threshold: int) -> DataFrame:
    """Lines of a batch that took longer than the threshold: milliseconds, query, id, label, score."""
    first = results.where("rank = 1").select("query_id", "doc_id", "label", F.format_string("%.2f", "score").alias("score"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    rows = queries.join(first, "query_id", "left").where(F.lit(milliseconds > threshold))
    return rows.select("query_id", F.concat_ws("\t", F.lit(str(milliseconds)), "q", dash("doc_id"), dash("label"), dash("score")).alias("line"))
