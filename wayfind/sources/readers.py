"""Sources of place documents, and their one normal form.

Normal form (`DOCUMENT`): doc_id, type, name, street, postcode, city, context (arrays: the first value is displayed, the
others are aliases), importance, lat, lon, fixed_score, housenumbers (map from the analyzed number to raw, lat, lon and
payload), action, and doc, the whole document as JSON with every other key.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.config import EngineConfig
from wayfind.functions.text import analyze

HOUSENUMBER = "struct<raw:string,lat:double,lon:double,payload:map<string,string>>"
#: Keys that are read apart; others stay in the JSON alone.
LISTS = ("type", "name", "street", "postcode", "city", "context")


def _strings(doc: Column, key: str) -> Column:
    """A scalar as an array of one, an array's scalars; null where the key is missing, null or nested."""
    raw = F.get_json_object(doc, f"$.{key}")
    many = F.from_json(raw, "array<string>")
    nested = F.exists(many, lambda x: F.coalesce(x, F.lit("")).rlike(r"^\s*[\[{]"))
    return F.when(raw.startswith("["), F.when(~nested, many)).when(~raw.startswith("{"), F.array(raw))


def invalid(doc: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Whether an indexed or filter field holds anything but scalars or an array of them."""
    bad = F.lit(False)
    for key in dict.fromkeys([f.key for f in config.indexed if f.kind != "housenumbers"] + list(config.filters)):
        bad = bad | (F.get_json_object(doc, f"$.{key}").isNotNull() & _strings(doc, key).isNull())
    return bad


def housenumbers_of(doc: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The housenumbers map by analyzed number ("3 bis": 3bis), raw added."""
    values = F.from_json(F.get_json_object(doc, f"$.{config.housenumbers_field}"), "map<string,string>")
    key = lambda k: F.array_join(F.transform(analyze(k, config), lambda t: t["tok"]), "")
    entry = lambda k, v: F.struct(
        key(k).alias("key"),
        F.struct(k.alias("raw"), F.get_json_object(v, "$.lat").cast("double").alias("lat"), F.get_json_object(v, "$.lon").cast("double").alias("lon"), F.map_filter(F.from_json(v, "map<string,string>"), lambda a, _: ~a.isin("lat", "lon")).alias("payload")).alias("value"),
    )
    entries = F.transform(F.map_entries(values), lambda e: entry(e["key"], e["value"]))
    distinct = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.coalesce(F.map_from_entries(distinct), F.from_json(F.lit("{}"), f"map<string,{HOUSENUMBER}>"))


def from_json(lines: DataFrame, config: EngineConfig = EngineConfig(), value: str = "value") -> DataFrame:
    """JSON strings to normal documents, with the lines' arrival column if they have one. Lines that are no JSON object, and documents with nested indexed fields, are left out. A missing _id is the hash of the document."""
    doc = F.col("doc")
    arrival = ["arrival"] if "arrival" in lines.columns else []
    rows = lines.select(F.trim(F.col(value)).alias("doc"), *arrival).where(F.try_parse_json("doc").isNotNull() & F.col("doc").startswith("{")).where(~invalid(doc, config))
    number = lambda k: F.get_json_object(doc, f"$.{k}").cast("double")
    return rows.select(
        F.coalesce(F.get_json_object(doc, "$._id"), F.substring(F.sha2(doc, 256), 1, 16)).alias("doc_id"), *[_strings(doc, k).alias(k) for k in LISTS],
        F.coalesce(number("importance"), F.lit(0.0)).alias("importance"), number("lat").alias("lat"), number("lon").alias("lon"), number("_score").alias("fixed_score"),
        housenumbers_of(doc, config).alias("housenumbers"), F.get_json_object(doc, "$._action").alias("action"), doc.alias("doc"), *arrival,
    )


def read_json_lines(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Lines keep the order of their file, as arrival; files are in order of their paths."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return from_json(spark.read.text(path).select("value", at.alias("arrival")), config)


def read_csv(spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), sample_chars: int = 1024) -> DataFrame:
    """The delimiter is sniffed from the first characters; the header names the fields."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())[:sample_chars]
    dialect = csv.Sniffer().sniff(head)
    rows = spark.read.csv(path, header=True, sep=dialect.delimiter, quote=dialect.quotechar or '"', escape='"', multiLine=False)
    return from_frame(rows, config)


def from_frame(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Any DataFrame whose columns are document fields."""
    return from_json(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")), config)


def read_msgpack(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Files of concatenated msgpack maps; needs the msgpack package on the executors."""
    import importlib.util

    if importlib.util.find_spec("msgpack") is None:
        raise ValueError("reading msgpack needs the msgpack package")

    def unpack(batches):
        import io
        import json

        import msgpack
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = msgpack.Unpacker(io.BytesIO(content), raw=False)
                yield pd.DataFrame({"value": [json.dumps(x) for x in rows]})

    return from_json(spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string"), config)


def read_stdin(spark: SparkSession, lines, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Lines of an iterable, such as sys.stdin."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("arrival", T.LongType())])
    return from_json(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], schema), config)
