"""Scoring of candidate documents against queries: (query, document) rows in, labels and scores out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import EngineConfig
from wayfind.functions import geo
from wayfind.functions.text import bigram_similarity, fold, label_match, string_similarity

#: Columns that a query brings: folded query, housenumber key, checks, mode and center.
QUERY = ("query_id", "q", "hn", "check_hn", "only_hn", "autocomplete", "lat", "lon")


def first(column: Column) -> Column:
    return F.coalesce(F.get(column, 0), F.lit(""))


def override(found: Column, key: str, own: Column) -> Column:
    return F.coalesce(found["payload"][key], own)


def with_housenumber(rows: DataFrame, found: Column) -> DataFrame:
    """Rows after a housenumber (null: none) has taken the place of its document: its number, position and payload."""
    rows = rows.withColumn("_hn", found)
    hit = F.col("_hn").isNotNull()
    return rows.withColumns(
        {
            "housenumber": F.col("_hn.raw"),
            "d_type": F.when(hit, F.lit("housenumber")).otherwise(first(F.col("type"))),
            "d_name": F.col("name"),
            "d_city": F.coalesce(F.col("_hn.payload")["city"], first(F.col("city"))),
            "d_postcode": F.coalesce(F.col("_hn.payload")["postcode"], first(F.col("postcode"))),
            "d_lat": F.coalesce("_hn.lat", "d_lat"),
            "d_lon": F.coalesce("_hn.lon", "d_lon"),
            "d_payload": F.col("_hn.payload"),
        }
    )


def match_housenumber(rows: DataFrame) -> DataFrame:
    """The query's number, if the document has it; in enforced mode documents without it go."""
    found = F.when(F.col("check_hn") & (F.col("hn") != ""), F.element_at("housenumbers", F.col("hn")))
    return with_housenumber(rows, found).where(~(F.col("check_hn") & F.col("only_hn")) | F.col("housenumber").isNotNull())


def nearest(numbers: Column, kind: str) -> Column:
    """Of a document's numbers (an array of structs of this kind, with lat and lon) whichever is nearest to the center; null: its own position is. Numbers win ties."""
    km = lambda lat, lon: geo.haversine_km(lat, lon, F.col("lat"), F.col("lon"))
    each = F.transform(numbers, lambda h, i: F.struct(km(h["lat"], h["lon"]).alias("km"), i.alias("i"), h.alias("h")))
    own = F.struct(km(F.col("d_lat"), F.col("d_lon")).alias("km"), F.lit(1_000_000_000).alias("i"), F.lit(None).cast(kind).alias("h"))
    near = lambda xs: F.aggregate(xs, F.get(xs, 0), lambda a, x: F.when((x["km"] < a["km"]) | ((x["km"] == a["km"]) & (x["i"] < a["i"])), x).otherwise(a))["h"]
    return F.when(F.col("check_hn"), near(F.when(F.col("only_hn"), each).otherwise(F.concat(each, F.array(own)))))


def closest_housenumber(rows: DataFrame) -> DataFrame:
    """Of the document's numbers and its own position, whichever is nearest to the center; numbers win ties. In enforced mode numbers alone count."""
    best = nearest(F.map_values("housenumbers"), "struct<raw:string,lat:double,lon:double,payload:map<string,string>>")
    return with_housenumber(rows, best).where(~(F.col("check_hn") & F.col("only_hn")) | F.col("housenumber").isNotNull())


def closest(pairs: DataFrame, points: DataFrame, documents: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """query_id, doc_id and the score in reverse search of each pair, as closest_housenumber and reverse_score give it, from positions alone: no names, numbers or payloads move."""
    spots = F.transform(F.map_values("housenumbers"), lambda h: F.struct(h["lat"].alias("lat"), h["lon"].alias("lon"), h["raw"].isNotNull().alias("named")))
    docs = documents.select("doc_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), "fixed_score", spots.alias("_spots"))
    rows = pairs.join(points.select("query_id", "lat", "lon", "check_hn", "only_hn"), "query_id").join(docs, "doc_id")
    rows = rows.withColumn("_at", nearest(F.col("_spots"), "struct<lat:double,lon:double,named:boolean>"))
    rows = rows.where(~(F.col("check_hn") & F.col("only_hn")) | F.coalesce("_at.named", F.lit(False)))
    rows = rows.select("query_id", "doc_id", "lat", "lon", "fixed_score", F.coalesce("_at.lat", "d_lat").alias("d_lat"), F.coalesce("_at.lon", "d_lon").alias("d_lon"))
    return geo_score(rows, config).select("query_id", "doc_id", reverse_score(config).alias("score"))


def reverse_score(config: EngineConfig) -> Column:
    return F.coalesce("fixed_score", F.col("geo_score") / F.lit(config.geo_distance_weight))


def make_labels(rows: DataFrame) -> DataFrame:
    """labels: the names, the first with housenumber, postcode and city around it; the city only where it isn't the name."""
    name, city = first(F.col("d_name")), F.col("d_city")
    place = F.when((city != "") & (city != name), F.concat(F.when(F.col("d_postcode") != "", F.concat(F.lit(" "), "d_postcode")).otherwise(F.lit("")), F.lit(" "), city)).otherwise(F.lit(""))
    number = F.when(F.coalesce("housenumber", F.lit("")) != "", F.concat("housenumber", F.lit(" "))).otherwise(F.lit(""))
    return rows.withColumn("labels", F.concat(F.array(F.concat(number, name, place)), F.slice("d_name", 2, 1_000_000)))


def until_match(labels: Column, score, threshold: float) -> Column:
    """The best score over the labels, none looked at after the first that reaches the threshold."""
    start = F.struct(F.lit(0.0).alias("best"), F.lit(False).alias("end"))
    scores = F.transform(labels, score)
    return F.aggregate(scores, start, lambda a, x: F.when(a["end"], a).otherwise(F.struct(F.greatest(a["best"], x).alias("best"), (x >= threshold).alias("end"))))["best"]


def ngram_score(labels: Column, query: Column, config: EngineConfig, scale: float = 1.0) -> Column:
    """labels and query folded."""
    return until_match(labels, lambda x: bigram_similarity(x, query) * F.lit(scale), config.match_threshold)


def autocomplete_score(labels: Column, query: Column, config: EngineConfig) -> Column:
    best = F.array_max(F.transform(labels, lambda x: label_match(query, x)))
    return F.when(best > 0, best).otherwise(ngram_score(labels, query, config, 0.9))


def score(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """str_distance, importance_score, distance (m), geo_score and score (their sum over the sum of their ceilings)."""
    rows = rows.withColumn("_folded", F.transform("labels", fold))
    plain = ngram_score(F.col("_folded"), F.col("q"), config)
    if config.scorer == "string":
        plain = F.array_max(F.transform("_folded", lambda x: F.coalesce(string_similarity(x, F.col("q")), F.lit(0.0))))
    text = F.when(F.col("autocomplete"), autocomplete_score(F.col("_folded"), F.col("q"), config)).otherwise(plain)
    rows = rows.withColumns({"str_raw": text, "importance_raw": F.col("importance") * F.lit(config.importance_weight)})
    return final_score(geo_score(rows, config), config).drop("_folded")


def geo_score(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    km = geo.haversine_km(F.col("d_lat"), F.col("d_lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("_km", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), km))
    return rows.withColumns({"distance": F.col("_km") * 1000, "geo_score": F.when(F.col("_km").isNotNull(), geo.km_to_score(F.col("_km")) * F.lit(config.geo_distance_weight))}).drop("_km")


def final_score(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """With a center the string score counts nine tenths and importance one tenth, ceilings as before."""
    center = F.col("geo_score").isNotNull()
    rows = rows.withColumns(
        {
            "str_distance": F.when(center, F.col("str_raw") * F.lit(0.9)).otherwise(F.col("str_raw")),
            "importance_score": F.when(center, F.col("importance_raw") * F.lit(0.1)).otherwise(F.col("importance_raw")),
        }
    )
    total = F.col("importance_score") + F.col("str_distance") + F.coalesce("geo_score", F.lit(0.0))
    ceiling = F.lit(config.importance_weight) + F.lit(1.0) + F.when(center, F.lit(config.geo_distance_weight)).otherwise(F.lit(0.0))
    return rows.withColumn("score", F.coalesce("fixed_score", total / ceiling))


def candidates(pairs: DataFrame, queries: DataFrame, documents: DataFrame, hint: str | None = None) -> DataFrame:
    """Rows for scoring from (query_id, doc_id) pairs. hint: how the pairs join, broadcast or merge, where files say too little about sizes."""
    docs = documents.withColumnsRenamed({"lat": "d_lat", "lon": "d_lon"}).drop("action")
    hinted = lambda rows: rows if hint is None else rows.hint(hint)
    return hinted(hinted(pairs).join(queries.select(*QUERY), "query_id")).join(docs, "doc_id")


def score_candidates(pairs: DataFrame, queries: DataFrame, documents: DataFrame, config: EngineConfig = EngineConfig(), hint: str | None = None) -> DataFrame:
    return score(make_labels(match_housenumber(candidates(pairs, queries, documents, hint))), config)
