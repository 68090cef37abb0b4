"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.config import EngineConfig
from wayfind.functions import geo, text
from wayfind.operators import index as ix
from wayfind.operators import inspect, retrieve
from wayfind.operators import score as sc
from wayfind.plans.places import config_for, place_queries, places
from wayfind.plans.search import Engine, folder
from wayfind.sources import sinks

SYNONYMS = {"small": "little tiny", "hot": "warm"}
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c):
    return F.round(c, 10)


#: SQL that the oracles share.
TOK = r"'[\p{L}\p{N}_]+'"
NORM = "replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
FOLD = r"trim(regexp_replace(regexp_replace(" + NORM + r", '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' {{2,}}', ' ', 'g'))"
PLACES_SQL = """
places AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS doc_id, c.c_custkey AS key, lower(c.c_mktsegment) AS type, p.p_name AS name, lpad(CAST(10000 + c.c_custkey % 90 AS VARCHAR), 5, '0') AS postcode,
    n.n_name AS city, r.r_name AS context, greatest(c.c_acctbal, 0.0::DOUBLE) / 10000 AS importance,
    48.0::DOUBLE + CAST(c.c_custkey % 997 AS DOUBLE) / 997.0::DOUBLE AS lat, 2.0::DOUBLE + CAST((c.c_custkey * 7919) % 1009 AS DOUBLE) / 1009.0::DOUBLE AS lon
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON p.p_partkey = c.c_custkey % (SELECT count(*) FROM part)
), numbers AS (
  SELECT o_custkey AS key, CAST(o_orderkey % 200 + 1 AS VARCHAR) AS number, min(o_orderkey) AS o FROM orders GROUP BY ALL
), hns AS (
  SELECT doc_id, number, lat + 1e-4::DOUBLE * CAST(o % 7 AS DOUBLE) AS lat, lon - 1e-4::DOUBLE * CAST(o % 7 AS DOUBLE) AS lon FROM places JOIN numbers USING (key)
)"""
POSTINGS_SQL = (
    PLACES_SQL
    + rf""", vals AS (
  SELECT doc_id, type, postcode, name AS v, 4.0::DOUBLE + importance * 0.1::DOUBLE AS b FROM places UNION ALL SELECT doc_id, type, postcode, city, 1.0::DOUBLE + importance * 0.1::DOUBLE FROM places
  UNION ALL SELECT doc_id, type, postcode, context, 1.0::DOUBLE + importance * 0.1::DOUBLE FROM places UNION ALL SELECT doc_id, type, postcode, postcode, 1.0::DOUBLE + importance * 0.1::DOUBLE FROM places
), toks AS (SELECT *, regexp_extract_all(lower(v), {TOK}) AS ts FROM vals),
postings AS (SELECT token, doc_id, max(bo) AS boost, any_value(type) AS type, any_value(postcode) AS postcode FROM (SELECT unnest(ts) AS token, doc_id, type, postcode, b / len(ts) AS bo FROM toks) GROUP BY token, doc_id),
stats AS (SELECT token, count(*) AS df, max(boost) AS max_boost FROM postings GROUP BY token)"""
)
BINS_SQL = "CAST(floor(({1} + 180.0::DOUBLE) / 360.0::DOUBLE * 262144) AS BIGINT) AS x, CAST(floor(({0} + 90.0::DOUBLE) / 180.0::DOUBLE * 131072) AS BIGINT) AS y"
HASH_SQL = "concat(" + ", ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + " + " + ".join(
        f"((({'{0}' if (5 * c + b) % 2 == 0 else '{1}'} >> {17 - (5 * c + b) // 2 if (5 * c + b) % 2 == 0 else 16 - (5 * c + b) // 2}) & 1) << {4 - b})" for b in range(5)) + " AS INTEGER), 1)"
    for c in range(7)) + ")"
HAVERSINE = "(2.0::DOUBLE * asin(sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))) * 6367.0::DOUBLE)"
BIGRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
SIM_SQL = """
g AS (SELECT *, {a} AS ga, {b} AS gb FROM s),
m AS (SELECT *, list_sum(list_transform(list_distinct(ga), lambda x: least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda y: y = x))))) AS common FROM g)
"""
RATIO = "CASE WHEN length(a) = 1 AND length(b) = 1 THEN CAST(a = b AS INTEGER)::DOUBLE WHEN coalesce(common, 0) = 0 THEN 0.0::DOUBLE ELSE common::DOUBLE / (len(ga) + len(gb) - common) END"


# analyzer


@query(rf"SELECT doc_id, i - 1 AS pos, ts[i] AS tok FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {TOK}) AS ts FROM documents))")
def tokenize_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.tokens_of(F.col("text"))).alias("pos", "tok")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS normalized FROM documents")
def normalize_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, sha256({FOLD.format('text')}) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g'), ' {2,}', ' ', 'g')) AS plain FROM conversations")
def alphanumerize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alphanumerize(F.col("text")).alias("plain"))


@query(rf"""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), {TOK}) AS ts FROM part), e AS (SELECT p_partkey, ts, unnest(range(1, len(ts) + 1)) AS i FROM t),
w AS (SELECT p_partkey, i - 1 AS pos, ts[i] AS raw, string_split(CASE ts[i] WHEN 'small' THEN 'little tiny' WHEN 'hot' THEN 'warm' ELSE ts[i] END, ' ') AS s FROM e)
SELECT p_partkey, pos, raw, unnest(range(0, len(s))) AS sub, unnest(s) AS tok FROM w""")
def synonymize(spark, sf_dir):
    toks = text.analyze(F.col("p_name"), EngineConfig(synonyms=SYNONYMS))
    out = table(spark, sf_dir, "part").select("p_partkey", F.explode(toks).alias("t"))
    return out.select("p_partkey", F.col("t.pos").cast("long").alias("pos"), F.col("t.raw"), F.col("t.sub").cast("long").alias("sub"), F.col("t.tok"))


@query(rf"""
WITH q AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS VARCHAR) || ' rue ' || o_orderpriority AS q FROM orders), t AS (SELECT o_orderkey, regexp_extract_all(lower(q), {TOK}) AS ts FROM q)
SELECT o_orderkey, ts[i] AS tok, CASE WHEN i = 1 AND regexp_full_match(ts[i], '[0-9]+') THEN 'housenumber' END AS kind FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM t)""")
def flag_housenumber(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.analyze(F.concat(F.expr("cast(o_orderkey % 50 as string)"), F.lit(" rue "), "o_orderpriority"))).alias("t"))
    return q.select("o_orderkey", "t.tok", "t.kind")


WORDS_SQL = rf"words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {TOK})) AS token FROM benchmark)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(text.tokens_of(F.lower("text"))).alias("token")).distinct()


@query(f"WITH {WORDS_SQL} SELECT token, substr(token, 1, CAST(n AS INTEGER)) AS prefix FROM (SELECT token, unnest(range(3, least(length(token), 21))) AS n FROM words)")
def edge_ngrams(spark, sf_dir):
    return words(spark, sf_dir).select("token", F.explode(text.edge_ngrams(F.col("token"))).alias("prefix"))


@query(f"WITH {WORDS_SQL} SELECT DISTINCT token, substr(' ' || token || ' ', CAST(i AS INTEGER), 3) AS gram FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM words)")
def char_trigrams(spark, sf_dir):
    return words(spark, sf_dir).select("token", F.explode(text.char_ngrams(F.col("token"))).alias("gram"))


def _fuzzy_sql() -> str:
    keys = ", ".join(f"('{k}', '{v}')" for k, v in EngineConfig().fuzzy_key_map.items())
    return f"""
WITH {WORDS_SQL}, near(k, v) AS (VALUES {keys}), az AS (SELECT chr(CAST(97 + i AS INTEGER)) AS c FROM range(26) t(i)), p AS (SELECT token, length(token) AS n, unnest(range(0, length(token) + 1)) AS i FROM words),
s AS (SELECT token, n, CAST(i AS INTEGER) AS i FROM p)
SELECT token, left(token, i - 1) || substr(token, i + 1, 1) || substr(token, i, 1) || substr(token, i + 2) AS neighbor FROM s WHERE i BETWEEN 1 AND n - 1
UNION SELECT token, left(token, i - 1) || c || substr(token, i + 1) FROM (SELECT token, i, unnest(string_split(v, '')) AS c FROM s JOIN near ON k = substr(token, i, 1) WHERE i BETWEEN 1 AND n) WHERE c <> substr(token, i, 1)
UNION SELECT token, left(token, i) || c || substr(token, i + 1) FROM s, az
UNION SELECT token, left(token, i - 1) || substr(token, i + 1) FROM s WHERE n > 3 AND i BETWEEN 1 AND n"""


@query(_fuzzy_sql())
def fuzzy_neighbors(spark, sf_dir):
    return words(spark, sf_dir).select("token", F.explode(text.fuzzy_neighbors(F.col("token"))).alias("neighbor"))


NAMES_SQL = f"s AS (SELECT c_custkey, {FOLD.format('p_name')} AS a, {FOLD.format('p_type')} AS b FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part))"


def names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n = part.count()
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"c_custkey % {n}").alias("p_partkey"))
    return c.join(part, "p_partkey").select("c_custkey", text.fold(F.col("p_name")).alias("a"), text.fold(F.col("p_type")).alias("b"))


@query(f"WITH {NAMES_SQL}, {SIM_SQL.format(a=BIGRAMS.format('a'), b=BIGRAMS.format('b'))} SELECT c_custkey, round({RATIO}, 10) AS similarity FROM m")
def sim_bigram_jaccard(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", rounded(text.bigram_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query(f"""
WITH {NAMES_SQL}, g AS (SELECT *, list_distinct(list_transform(range(1, length(a) + 1), lambda i: substr(' ' || a || ' ', i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) + 1), lambda i: substr(' ' || b || ' ', i, 3))) AS gb FROM s),
m AS (SELECT *, len(list_intersect(ga, gb))::DOUBLE AS n, (levenshtein(a, b) - abs(length(a) - length(b)))::DOUBLE / greatest(length(a), length(b)) AS d FROM g)
SELECT c_custkey, round(n / len(gb) * 0.85::DOUBLE + n / len(ga) * 0.05::DOUBLE + (1 - d) * 0.1::DOUBLE, 10) AS similarity FROM m""")
def sim_compare_str(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", rounded(text.string_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query(f"WITH {NAMES_SQL}, q AS (SELECT *, substr(a, 1 + CAST(c_custkey % 3 AS INTEGER), CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 100 END) AS q FROM s) SELECT c_custkey, CASE WHEN q = a THEN 1.0 WHEN starts_with(a, q) THEN 0.9 WHEN contains(a, q) THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM q")
def label_equals_starts_contains(spark, sf_dir):
    q = F.expr("substring(a, cast(1 + c_custkey % 3 as int), case when c_custkey % 2 = 0 then 4 else 100 end)")
    return names(spark, sf_dir).select("c_custkey", text.label_match(q, F.col("a")).alias("score"))


# geo


@query(f"WITH {PLACES_SQL} SELECT doc_id, round({HAVERSINE.format('lat', 'lon', '48.5::DOUBLE', '2.5::DOUBLE')}, 10) AS km FROM places")
def haversine_km(spark, sf_dir):
    return places(spark, sf_dir).select("doc_id", rounded(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.5), F.lit(2.5))).alias("km"))


@query(f"WITH {PLACES_SQL}, k AS (SELECT doc_id, {HAVERSINE.format('lat', 'lon', '48.0::DOUBLE', '2.0::DOUBLE')} AS km FROM places) SELECT doc_id, round(CASE WHEN km > 100 THEN 0.0 ELSE exp(-pow(km / 50, 2)) END::DOUBLE, 10) AS score FROM k")
def km_to_score(spark, sf_dir):
    return places(spark, sf_dir).select("doc_id", rounded(geo.km_to_score(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)))).alias("score"))


@query(f"WITH {PLACES_SQL}, b AS (SELECT doc_id, {BINS_SQL.format('lat', 'lon')} FROM places) SELECT doc_id, {HASH_SQL.format('x', 'y')} AS geohash FROM b")
def geohash_encode(spark, sf_dir):
    return places(spark, sf_dir).select("doc_id", geo.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


AROUND_SQL = "n AS (SELECT {0}, x + dx AS x, y + dy AS y FROM b, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"


@query(f"WITH {PLACES_SQL}, b AS (SELECT doc_id, {BINS_SQL.format('lat', 'lon')} FROM places), {AROUND_SQL.format('doc_id')} SELECT doc_id, {HASH_SQL.format('x', 'y')} AS geohash FROM n")
def geohash_expand(spark, sf_dir):
    return places(spark, sf_dir).select("doc_id", F.explode(geo.expand_geohash(F.col("lat"), F.col("lon"))).alias("geohash"))


@query(f"WITH {PLACES_SQL}, b AS (SELECT doc_id, {BINS_SQL.format('lat', 'lon')} FROM places) SELECT doc_id, round(y * (180.0::DOUBLE / 131072) - 90, 10) AS south, round(x * (360.0::DOUBLE / 262144) - 180, 10) AS west, round((y + 1) * (180.0::DOUBLE / 131072) - 90, 10) AS north, round((x + 1) * (360.0::DOUBLE / 262144) - 180, 10) AS east FROM b")
def geohash_bbox(spark, sf_dir):
    box = places(spark, sf_dir).select("doc_id", geo.cell_bbox(geo.x_bin(F.col("lon"), 7), geo.y_bin(F.col("lat"), 7)).alias("b"))
    return box.select("doc_id", *[rounded(F.col(f"b.{c}")).alias(c) for c in ("south", "west", "north", "east")])


# index


@query(f"WITH {POSTINGS_SQL} SELECT token, doc_id, round(boost, 10) AS boost FROM postings")
def postings_boost(spark, sf_dir):
    return ix.postings(places(spark, sf_dir)).select("token", "doc_id", rounded("boost").alias("boost"))


@query(f"WITH {POSTINGS_SQL} SELECT token, df FROM stats")
def token_frequency(spark, sf_dir):
    return ix.token_stats(ix.postings(places(spark, sf_dir))).select("token", "df")


@query(f"WITH {POSTINGS_SQL} SELECT token, round(max_boost, 10) AS max_boost FROM stats")
def token_max_boost(spark, sf_dir):
    return ix.token_stats(ix.postings(places(spark, sf_dir))).select("token", rounded("max_boost").alias("max_boost"))


PAIRS_SQL = "pairs AS (SELECT DISTINCT a.token, b.token AS other FROM postings a JOIN postings b USING (doc_id) WHERE a.token <> b.token)"
NGRAMS_SQL = "ngrams AS (SELECT substr(token, 1, CAST(n AS INTEGER)) AS prefix, token FROM (SELECT token, unnest(range(3, least(length(token), 21))) AS n FROM stats WHERE NOT regexp_full_match(token, '[0-9]+')))"


@query(f"WITH {POSTINGS_SQL}, {PAIRS_SQL} SELECT token, other FROM pairs")
def pairs_index(spark, sf_dir):
    return ix.pairs(ix.postings(places(spark, sf_dir)))


@query(f"WITH {POSTINGS_SQL}, {NGRAMS_SQL} SELECT prefix, token FROM ngrams")
def edge_ngram_index(spark, sf_dir):
    return ix.edge_ngram_table(ix.token_stats(ix.postings(places(spark, sf_dir))))


CELLS_SQL = f"spots AS (SELECT doc_id, lat, lon FROM places UNION ALL SELECT doc_id, lat, lon FROM hns), c AS (SELECT DISTINCT doc_id, {BINS_SQL.format('lat', 'lon')} FROM spots)"


@query(f"WITH {PLACES_SQL}, {CELLS_SQL} SELECT doc_id, {HASH_SQL.format('x', 'y')} AS geohash FROM c")
def geo_cells_index(spark, sf_dir):
    return ix.geo_cells(places(spark, sf_dir)).select("doc_id", "geohash")


@query(f"WITH {PLACES_SQL} SELECT 'type' AS name, type AS value, doc_id FROM places UNION ALL SELECT 'postcode', postcode, doc_id FROM places UNION ALL SELECT DISTINCT 'type', 'housenumber', doc_id FROM hns")
def filters_index(spark, sf_dir):
    return ix.filter_table(places(spark, sf_dir)).select("name", "value", "doc_id")


@query(f"WITH {PLACES_SQL} SELECT doc_id, number AS key, round(lat, 10) AS lat, round(lon, 10) AS lon FROM hns")
def housenumber_keys(spark, sf_dir):
    rows = places(spark, sf_dir).select("doc_id", F.explode(F.map_entries("housenumbers")).alias("h"))
    return rows.select("doc_id", F.col("h.key").alias("key"), rounded("h.value.lat").alias("lat"), rounded("h.value.lon").alias("lon"))


@query(f"WITH {POSTINGS_SQL} SELECT token, count(*) AS df FROM postings WHERE CAST(doc_id AS BIGINT) % 5 <> 0 GROUP BY token")
def index_apply_delete(spark, sf_dir):
    docs = places(spark, sf_dir)
    gone = docs.where("cast(doc_id as bigint) % 5 = 0").withColumn("action", F.lit("delete"))
    return ix.apply_changes(ix.build(docs), gone).token_stats.select("token", "df")


@query(f"""WITH {POSTINGS_SQL}, moved AS (SELECT token, doc_id FROM postings p WHERE CAST(doc_id AS BIGINT) % 5 <> 0
UNION SELECT unnest(['moved', 'place']), doc_id FROM places WHERE CAST(doc_id AS BIGINT) % 5 = 0
UNION SELECT unnest(ts), doc_id FROM toks JOIN places USING (doc_id) WHERE CAST(doc_id AS BIGINT) % 5 = 0 AND v <> name)
SELECT token, count(*) AS df FROM moved GROUP BY token""")
def index_apply_update(spark, sf_dir):
    docs = places(spark, sf_dir)
    new = docs.where("cast(doc_id as bigint) % 5 = 0").withColumns({"action": F.lit("update"), "name": F.array(F.lit("moved place"))})
    return ix.apply_changes(ix.build(docs), new).token_stats.select("token", "df")


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, count(*) AS tokens FROM postings WHERE CAST(doc_id AS BIGINT) % 3 <> 0 GROUP BY doc_id")
def doc_null_name_rejected(spark, sf_dir):
    docs = places(spark, sf_dir).withColumn("name", F.expr("case when cast(doc_id as bigint) % 3 = 0 then null else name end"))
    return ix.build(docs).postings.groupBy("doc_id").agg(F.count("*").alias("tokens"))


# retrieval

TWO_SQL = "q AS (SELECT key AS query_id, type, regexp_extract_all(lower(name), '[a-z]+') AS ts FROM places)"
HITS_SQL = "k AS (SELECT query_id, type, len(list_distinct(ts)) AS n, unnest(list_distinct(ts)) AS token FROM q), h AS (SELECT query_id, doc_id, sum(boost) AS boost FROM k JOIN postings p USING (token) {0} GROUP BY query_id, n, doc_id HAVING count(*) = n)"
TOP_SQL = "SELECT query_id, doc_id, round(boost, 10) AS boost, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, doc_id DESC) AS rank FROM h) WHERE rank <= 10"


def two_word_attempts(spark, sf_dir, filtered=False):
    p = places(spark, sf_dir)
    fl = F.array(F.array(F.concat(F.lit("type="), F.get("type", F.lit(0))))) if filtered else F.array().cast("array<array<string>>")
    return p.select(F.col("doc_id").cast("long").alias("query_id"), F.lit(0).alias("no"), text.tokens_of(F.lower(F.get("name", F.lit(0)))).alias("toks"), F.lit(False).alias("geo"), fl.alias("fl"), F.lit(10).alias("cap"))


def _index(spark, sf_dir, config=EngineConfig()):
    return ix.build(places(spark, sf_dir), config)


@query(f"WITH {POSTINGS_SQL}, {TWO_SQL}, {HITS_SQL.format('')} {TOP_SQL}")
def zinter_topk(spark, sf_dir):
    hits = retrieve.intersect_once(_index(spark, sf_dir), two_word_attempts(spark, sf_dir), most=10)
    return hits.select("query_id", "doc_id", rounded("boost").alias("boost"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POSTINGS_SQL}, {TWO_SQL}, {HITS_SQL.format('WHERE p.type = k.type')} {TOP_SQL}")
def zinter_filtered(spark, sf_dir):
    hits = retrieve.intersect_once(_index(spark, sf_dir), two_word_attempts(spark, sf_dir, True), most=10)
    return hits.select("query_id", "doc_id", rounded("boost").alias("boost"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {POSTINGS_SQL}, {TWO_SQL}, a AS (SELECT query_id, ts[1] AS token, list_distinct(ts) AS ts FROM q),
t AS (SELECT query_id, ts, token, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, doc_id DESC) AS r FROM a JOIN postings USING (token)),
o AS (SELECT query_id, doc_id, r, len(ts) AS n, unnest(ts) AS token FROM t WHERE r <= 51),
f AS (SELECT query_id, doc_id, r FROM o JOIN postings USING (token, doc_id) GROUP BY query_id, doc_id, r, n HAVING count(*) = n)
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n FROM f) WHERE n <= 5""")
def manual_scan(spark, sf_dir):
    return retrieve.manual_scan(_index(spark, sf_dir), two_word_attempts(spark, sf_dir).withColumn("wanted", F.lit(5)), rows=51)


@query(f"WITH {POSTINGS_SQL} SELECT token, df, row_number() OVER (ORDER BY df DESC, token) AS rank FROM stats")
def order_by_frequency(spark, sf_dir):
    i = _index(spark, sf_dir)
    out = retrieve.order_by_frequency(i, i.token_stats.select("token"))
    return out.select("token", "df", F.row_number().over(Window.orderBy(F.desc("df"), "token")).cast("long").alias("rank"))


@query(f"WITH {POSTINGS_SQL} SELECT token, round(max_boost, 10) AS max_boost FROM stats")
def order_by_max_score(spark, sf_dir):
    i = _index(spark, sf_dir)
    return retrieve.order_by_max_score(i, i.token_stats.select("token")).select("token", rounded("max_boost").alias("max_boost"))


@query(f"WITH {PLACES_SQL} SELECT 1::BIGINT AS query_id, doc_id FROM places WHERE type IN ('building', 'machinery')")
def filter_or(spark, sf_dir):
    return _filtered(spark, sf_dir, {"type": [" building", "machinery", "building", " "]})


@query(f"WITH {PLACES_SQL} SELECT 1::BIGINT AS query_id, doc_id FROM places WHERE type IN ('building', 'machinery') AND postcode IN ('10001', '10002', '10003')")
def filter_and(spark, sf_dir):
    return _filtered(spark, sf_dir, {"type": ["machinery", "building"], "postcode": ["10003", "10001", "10002"]})


def _filtered(spark, sf_dir, filters):
    q = spark.createDataFrame([(1, filters)], "query_id long, filters map<string,array<string>>")
    return retrieve.documents_with(_index(spark, sf_dir), q.select("query_id", retrieve.filter_groups(F.col("filters")).alias("fl")))


@query("SELECT conv_id, list_sort(list_distinct(list_filter(list_transform(string_split(string_agg(role, ', ' ORDER BY turn), ','), lambda x: trim(x)), lambda x: x <> '')))[1:10] AS vs FROM conversations GROUP BY conv_id")
def normalize_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ", ").alias("r"))
    return c.select("conv_id", retrieve.normalize_filter(F.split("r", ",")).alias("vs"))


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, round(boost, 10) AS boost FROM postings WHERE token = 'small' ORDER BY boost DESC, doc_id LIMIT 21")
def best_score(spark, sf_dir):
    return inspect.best_score(_index(spark, sf_dir), "small").select("doc_id", rounded("boost").alias("boost"))


@query(f"WITH {POSTINGS_SQL} SELECT token, doc_id, round(boost, 10) AS boost, rank() OVER (PARTITION BY token ORDER BY boost DESC) AS rank FROM postings")
def index_rank(spark, sf_dir):
    return inspect.index_rank(_index(spark, sf_dir)).select("token", "doc_id", rounded("boost").alias("boost"), F.col("rank").cast("long").alias("rank"))


#: Swapped letters, a letter less, a neighbouring key, a letter more.
NEAR_SMAL_SQL = r"""token IN ('msal', 'saml', 'smla', 'mal', 'sal', 'sml', 'sma') OR regexp_full_match(token, '[qzedxw]mal|s[lpu]al|sm[ezqop]l|sma[kom]')
  OR (length(token) = 5 AND len(list_filter(range(1, 6), lambda i: left(token, i - 1) || substr(token, i + 1) = 'smal' AND substr(token, i, 1) BETWEEN 'a' AND 'z')) > 0)"""


@query(f"WITH {POSTINGS_SQL} SELECT token, df FROM stats WHERE ({NEAR_SMAL_SQL})")
def fuzzy_index(spark, sf_dir):
    return inspect.fuzzy_index(_index(spark, sf_dir), "smal")


@query(f"WITH {POSTINGS_SQL}, {NGRAMS_SQL} SELECT token FROM ngrams WHERE prefix = 'nat'")
def autocomplete_token(spark, sf_dir):
    return inspect.autocomplete(_index(spark, sf_dir), "nat")


@query(f"WITH {POSTINGS_SQL}, {PAIRS_SQL} SELECT other FROM pairs WHERE token = 'small'")
def pair_token(spark, sf_dir):
    return inspect.pair(_index(spark, sf_dir), "small")


@query(f"WITH {PLACES_SQL}, {CELLS_SQL}, b AS (SELECT key, {BINS_SQL.format('lat', 'lon')} FROM places), {AROUND_SQL.format('key')} SELECT DISTINCT key AS query_id, c.doc_id FROM n JOIN c USING (x, y)")
def geohash_members(spark, sf_dir):
    p = places(spark, sf_dir)
    q = p.select(F.col("doc_id").cast("long").alias("query_id"), "lat", "lon", F.array().cast("array<array<string>>").alias("fl"))
    return retrieve.near(_index(spark, sf_dir), q)


# scoring

PAIRS_OF_PLACES = "pp AS (SELECT q.key AS query_id, d.*, lower(q.name || ' ' || q.city) AS q, CAST(1 + q.key % 200 AS VARCHAR) AS hn, q.lat AS qlat, q.lon AS qlon, q.key % 2 = 0 AS centered FROM places q JOIN places d ON d.key BETWEEN q.key - 3 AND q.key + 3)"


def scoring_rows(spark, sf_dir, center=True):
    p = places(spark, sf_dir).withColumn("key", F.col("doc_id").cast("long"))
    n = lambda c: F.get(c, F.lit(0))
    q = p.select(
        F.col("key").alias("query_id"), text.fold(F.concat_ws(" ", n("name"), n("city"))).alias("q"), F.expr("cast(1 + key % 200 as string)").alias("hn"), F.lit(True).alias("check_hn"), F.lit(False).alias("only_hn"),
        F.lit(False).alias("autocomplete"), F.when((F.col("key") % 2 == 0) & F.lit(center), F.col("lat")).alias("lat"), F.when((F.col("key") % 2 == 0) & F.lit(center), F.col("lon")).alias("lon"),
    )
    near = F.transform(F.sequence(F.col("query_id") - 3, F.col("query_id") + 3), lambda i: i.cast("string"))
    pairs = q.select("query_id", F.explode(near).alias("doc_id"))
    return sc.candidates(pairs, q, p.drop("key"))


MATCH_SQL = f"WITH {PLACES_SQL}, {PAIRS_OF_PLACES}, mh AS (SELECT pp.*, h.number AS housenumber, coalesce(h.lat, pp.lat) AS d_lat, coalesce(h.lon, pp.lon) AS d_lon FROM pp LEFT JOIN hns h ON h.doc_id = pp.doc_id AND h.number = pp.hn), ml AS (SELECT *, CASE WHEN housenumber IS NULL THEN '' ELSE housenumber || ' ' END || name || ' ' || postcode || ' ' || city AS label FROM mh)"


@query(f"{MATCH_SQL} SELECT query_id, doc_id, housenumber, CASE WHEN housenumber IS NULL THEN type ELSE 'housenumber' END AS type, round(d_lat, 10) AS lat FROM mh")
def match_housenumber(spark, sf_dir):
    return sc.match_housenumber(scoring_rows(spark, sf_dir)).select("query_id", "doc_id", "housenumber", F.col("d_type").alias("type"), rounded("d_lat").alias("lat"))


@query(f"{MATCH_SQL} SELECT query_id, doc_id, label FROM ml")
def make_labels(spark, sf_dir):
    return sc.make_labels(sc.match_housenumber(scoring_rows(spark, sf_dir))).select("query_id", "doc_id", F.get("labels", F.lit(0)).alias("label"))


@query(f"{MATCH_SQL} SELECT query_id, doc_id, round(importance * 0.1::DOUBLE * CASE WHEN centered THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM mh")
def score_importance(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "doc_id", rounded("importance_score").alias("score"))


SCORED_SQL = f"{MATCH_SQL}, s AS (SELECT *, lower(label) AS a, q AS b FROM ml), {SIM_SQL.format(a=BIGRAMS.format('a'), b=BIGRAMS.format('b'))}, ng AS (SELECT *, {RATIO} AS str, {HAVERSINE.format('d_lat', 'd_lon', 'qlat', 'qlon')} AS km FROM m), sc AS (SELECT *, CASE WHEN km > 100 THEN 0.0 ELSE exp(-pow(km / 50, 2)) END * 0.1::DOUBLE AS geo FROM ng), fs AS (SELECT *, CASE WHEN centered THEN (importance * 0.1::DOUBLE * 0.1::DOUBLE + str * 0.9::DOUBLE + geo) / 1.2::DOUBLE ELSE (importance * 0.1::DOUBLE + str) / 1.1::DOUBLE END AS score FROM sc)"


def scored(spark, sf_dir):
    return sc.score(sc.make_labels(sc.match_housenumber(scoring_rows(spark, sf_dir))))


@query(f"{SCORED_SQL} SELECT query_id, doc_id, round(str, 10) AS score FROM ng")
def score_ngram(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "doc_id", rounded("str_raw").alias("score"))


@query(f"{SCORED_SQL} SELECT query_id, doc_id, round(CASE WHEN q = lower(label) THEN 1.0::DOUBLE WHEN starts_with(lower(label), q) THEN 0.9::DOUBLE WHEN contains(lower(label), q) THEN 0.7::DOUBLE ELSE str * 0.9::DOUBLE END, 10) AS score FROM ng")
def score_autocomplete(spark, sf_dir):
    rows = sc.make_labels(sc.match_housenumber(scoring_rows(spark, sf_dir)))
    return rows.select("query_id", "doc_id", rounded(sc.autocomplete_score(F.transform("labels", text.fold), F.col("q"), EngineConfig())).alias("score"))


@query(f"{SCORED_SQL} SELECT query_id, doc_id, round(km * 1000, 3) AS distance, round(geo, 10) AS score FROM sc WHERE centered")
def score_geo(spark, sf_dir):
    return scored(spark, sf_dir).where("distance is not null").select("query_id", "doc_id", F.round("distance", 3).alias("distance"), rounded("geo_score").alias("score"))


@query(f"{SCORED_SQL} SELECT query_id, doc_id, round(CASE WHEN centered THEN str * 0.9::DOUBLE ELSE str END, 10) AS str_distance, round(CASE WHEN centered THEN importance * 0.1::DOUBLE * 0.1::DOUBLE ELSE importance * 0.1::DOUBLE END, 10) AS importance_score FROM sc")
def adjust_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "doc_id", rounded("str_distance").alias("str_distance"), rounded("importance_score").alias("importance_score"))


@query(f"{SCORED_SQL} SELECT query_id, doc_id, round(score, 10) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM fs) WHERE r <= 3")
def final_score_topk(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 3").select("query_id", "doc_id", rounded("score").alias("score"))


# reverse


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine.of_documents(places(spark, sf_dir), config_for, folder(spark))


def points(spark, sf_dir, filters=None, off=0.0001, limit=3):
    p = places(spark, sf_dir)
    f = F.create_map(*[x for k, v in (filters or {}).items() for x in (F.lit(k), F.array(*map(F.lit, v)))]).cast("map<string,array<string>>") if filters else F.create_map().cast("map<string,array<string>>")
    return p.select(F.col("doc_id").cast("long").alias("query_id"), (F.col("lat") + off).alias("lat"), (F.col("lon") + off).alias("lon"), F.lit(limit).alias("limit"), f.alias("filters"))


def _reverse_sql(off: float, numbers: bool, only: bool = False, where: str = "") -> str:
    """numbers: whether housenumbers count; only: whether they alone do; where: the filter. The second ring is for points without a document in the first."""
    own = f"SELECT doc_id, lat, lon, NULL::VARCHAR AS number, 1 AS o FROM places {where}"
    each = "SELECT doc_id, lat, lon, number, 0 AS o FROM hns"
    spots = each if only else f"{own} UNION ALL {each}" if numbers else own
    ring = "SELECT query_id, x + dx AS x, y + dy AS y FROM b, (SELECT unnest({0}) AS dx), (SELECT unnest({0}) AS dy)"
    return f"""WITH {PLACES_SQL}, {CELLS_SQL}, q AS (SELECT key AS query_id, lat + {off}::DOUBLE AS qlat, lon + {off}::DOUBLE AS qlon FROM places),
b AS (SELECT query_id, {BINS_SQL.format('qlat', 'qlon')} FROM q), n1 AS ({ring.format('[-1, 0, 1]')}), n2 AS ({ring.format('[-2, -1, 0, 1, 2]')}),
ok AS (SELECT DISTINCT doc_id FROM {'hns' if only else f'places {where}'}), m1 AS (SELECT DISTINCT query_id, doc_id FROM n1 JOIN c USING (x, y) JOIN ok USING (doc_id)),
m AS (SELECT * FROM m1 UNION SELECT query_id, doc_id FROM n2 JOIN c USING (x, y) JOIN ok USING (doc_id) WHERE query_id NOT IN (SELECT query_id FROM m1)), e AS ({spots}),
d AS (SELECT query_id, e.doc_id, number, o, {HAVERSINE.format('e.lat', 'e.lon', 'qlat', 'qlon')} AS km FROM m JOIN q USING (query_id) JOIN e USING (doc_id)),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY km, o, CAST(number AS INTEGER)) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN km > 100 THEN 0.0 ELSE exp(-pow(km / 50, 2)) END DESC, doc_id) AS rank FROM f)
SELECT query_id, rank, doc_id, round(km * 1000, 3) AS distance{', number AS housenumber' if numbers else ''} FROM r WHERE rank <= 3"""


def _reverse(spark, sf_dir, filters, off, numbers):
    out = Engine(_index(spark, sf_dir)).reverse(points(spark, sf_dir, filters, off))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("distance", 3).alias("distance"), *(["housenumber"] if numbers else []))


@query(_reverse_sql(0.0001, True))
def reverse_housenumber(spark, sf_dir):
    return _reverse(spark, sf_dir, None, 0.0001, True)


@query(_reverse_sql(0.0001, False, where="WHERE type = 'building'"))
def reverse_filtered(spark, sf_dir):
    return _reverse(spark, sf_dir, {"type": ["building"]}, 0.0001, False)


@query(_reverse_sql(0.0001, True, only=True))
def reverse_only_housenumber(spark, sf_dir):
    return _reverse(spark, sf_dir, {"type": ["housenumber"]}, 0.0001, True)


@query(_reverse_sql(0.0035, True))
def reverse_second_ring(spark, sf_dir):
    return _reverse(spark, sf_dir, None, 0.0035, True)


@query(_reverse_sql(0.00005, False, where="WHERE type IN ('building', 'machinery', 'household', 'automobile', 'furniture')"))
def reverse_nearest(spark, sf_dir):
    return _reverse(spark, sf_dir, {"type": ["building", "machinery", "household", "automobile", "furniture"]}, 0.00005, False)


# search

def _search(spark, sf_dir, kind: int | None = None) -> DataFrame:
    places_engine = engine(spark, sf_dir)
    out = places_engine.search(place_queries(spark, sf_dir, kind, places_engine.index.documents))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "label", rounded("score").alias("score"))


#: Searches for one word that at least ten documents hold: its best hundred postings are the candidates, and no later
#: collector adds to them. Fewer documents would bring in misspellings; the driver's names have no word so like another.
ONE_WORD_SQL = f"""WITH {POSTINGS_SQL}, w AS (SELECT key AS query_id, lower(string_split(name, ' ')[1]) AS q FROM places), each AS (SELECT DISTINCT q FROM w),
top AS (SELECT q, doc_id FROM each JOIN postings ON token = q QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(boost, 12) DESC, doc_id DESC) <= 100),
s AS (SELECT q, doc_id, importance, name || ' ' || postcode || CASE WHEN city = name THEN '' ELSE ' ' || city END AS label, lower(label) AS a, q AS b FROM top JOIN places USING (doc_id)),
{SIM_SQL.format(a=BIGRAMS.format('a'), b=BIGRAMS.format('b'))}, sc AS (SELECT q, doc_id, label, (importance * 0.1::DOUBLE + {RATIO}) / 1.1::DOUBLE AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT query_id, rank, doc_id, label, round(score, 10) AS score FROM w JOIN r USING (q) WHERE rank <= 10 AND score >= 0.1::DOUBLE"""
KIND_SQL = {"search_only_commons": ONE_WORD_SQL}


def _kind(name: str, kind: int):
    def run(spark, sf_dir):
        return _search(spark, sf_dir, kind)

    run.__name__ = name
    query(KIND_SQL.get(name))(run)


for _name, _number in (("search_meaningful", 0), ("search_fuzzy", 1), ("search_autocomplete", 2), ("search_housenumber", 3), ("search_filtered", 4), ("search_geo_bias", 5), ("search_only_commons", 6), ("search_reduce_tokens", 7)):
    _kind(_name, _number)


@query()
def search_full(spark, sf_dir):
    """The eight kinds of queries in turn, one for every place."""
    return _search(spark, sf_dir)


@query()
def search_batch(spark, sf_dir):
    """A query for every place, in one batch."""
    return _search(spark, sf_dir)


@query()
def search_candidates(spark, sf_dir):
    places_engine = engine(spark, sf_dir)
    out = places_engine.candidates(place_queries(spark, sf_dir, docs=places_engine.index.documents))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "label", rounded("score").alias("score"), F.size("matched").alias("matched"))


FEATURE = "from_json(feature, 'type string, geometry struct<type: string, coordinates: array<double>>, properties map<string, string>')"


@query(f"""{SCORED_SQL} SELECT query_id, doc_id, 'Feature' AS kind, 'Point' AS shape, round(d_lon, 10) AS lon, round(d_lat, 10) AS lat, label, housenumber, round(score, 10) AS score,
  CASE WHEN housenumber IS NULL THEN type ELSE 'housenumber' END AS type, CASE WHEN housenumber IS NULL THEN name ELSE housenumber || ' ' || name END AS name, postcode, city,
  CASE WHEN centered THEN CAST(trunc(km * 1000) AS BIGINT) END AS distance FROM fs""")
def geojson_features(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("label", F.get("labels", F.lit(0)))
    out = rows.select("query_id", "doc_id", sinks.feature().alias("feature")).withColumn("f", F.expr(FEATURE))
    p = F.col("f.properties")
    return out.select(
        "query_id", "doc_id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"), rounded(F.col("f.geometry.coordinates")[0]).alias("lon"), rounded(F.col("f.geometry.coordinates")[1]).alias("lat"),
        p["label"].alias("label"), p["housenumber"].alias("housenumber"), rounded(p["score"].cast("double")).alias("score"), p["type"].alias("type"), p["name"].alias("name"), p["postcode"].alias("postcode"), p["city"].alias("city"), p["distance"].cast("long").alias("distance"),
    )


def queries() -> dict:
    from wayfind.plans import intake  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from wayfind.plans import intake  # noqa: F401

    return dict(_SQL)
