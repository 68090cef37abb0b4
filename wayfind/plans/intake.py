"""Queries over sources, the document store, change feeds and query preparation, each with its SQL. Importing this module registers them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.config import EngineConfig, load_synonyms
from wayfind.functions import text
from wayfind.operators import index as ix
from wayfind.operators import retrieve
from wayfind.plans.collect import Chain
from wayfind.plans.places import config_for, place_queries, places
from wayfind.plans.queries import CELLS_SQL, FOLD, HASH_SQL, NGRAMS_SQL, PAIRS_SQL, PLACES_SQL, POSTINGS_SQL, TOK, _index, query, rounded, table
from wayfind.plans.search import Engine, folder
from wayfind.sources import readers
from wayfind.sources.store import DocumentStore

# sources


def read_back(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The normal documents of a table of lines, through files of JSON lines."""
    at = folder(spark)
    lines.write.text(at)
    return readers.read_json_lines(spark, at)


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS name, n_name AS city, round(c_acctbal, 10) AS importance FROM customer JOIN nation ON c_nationkey = n_nationkey")
def json_lines_source(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    doc = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("c_acctbal").alias("importance")))
    out = read_back(spark, rows.select(doc.alias("value")))
    return out.select("doc_id", F.get("name", F.lit(0)).alias("name"), F.get("city", F.lit(0)).alias("city"), rounded("importance").alias("importance"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS name FROM customer WHERE c_custkey % 4 = 0")
def bad_rows_dropped(spark, sf_dir):
    """Of each four lines one is a document, one is cut off, one is an array, and one has an object for a name."""
    key = F.col("c_custkey").cast("string")
    whole = F.to_json(F.struct(key.alias("_id"), F.col("c_name").alias("name")))
    nested = F.to_json(F.struct(key.alias("_id"), F.struct(F.col("c_name").alias("fr")).alias("name")))
    turn = F.col("c_custkey") % 4
    line = F.when(turn == 0, whole).when(turn == 1, F.expr("left(c_name, 4)")).when(turn == 2, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(nested)
    return read_back(spark, table(spark, sf_dir, "customer").select(line.alias("value"))).select("doc_id", F.get("name", F.lit(0)).alias("name"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '|' || c_mktsegment END AS names FROM customer")
def scalar_to_array(spark, sf_dir):
    """Scalars and arrays in the same field of different documents."""
    key = F.col("c_custkey").cast("string").alias("_id")
    line = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(key, F.col("c_name").alias("name")))).otherwise(F.to_json(F.struct(key, F.array("c_name", "c_mktsegment").alias("name"))))
    return read_back(spark, table(spark, sf_dir, "customer").select(line.alias("value"))).select("doc_id", F.array_join("name", "|").alias("names"))


@query("""SELECT left(sha256('{"name":"' || c_name || '"}'), 16) AS doc_id, c_name AS name FROM customer""")
def hashed_ids(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("c_name").alias("name")))
    return read_back(spark, table(spark, sf_dir, "customer").select(doc.alias("value"))).select("doc_id", F.get("name", F.lit(0)).alias("name"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name || '; \"' || c_mktsegment || '\"' AS name, c_mktsegment AS city FROM customer")
def csv_source(spark, sf_dir):
    """Semicolons and quotes inside of a quoted field."""
    c = table(spark, sf_dir, "customer")
    at = folder(spark)
    name = F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('"'))
    c.select(F.col("c_custkey").alias("_id"), name.alias("name"), F.col("c_mktsegment").alias("city")).write.csv(at, header=True, sep=";", quoteAll=True, escape='"')
    return readers.read_csv(spark, at).select("doc_id", F.get("name", F.lit(0)).alias("name"), F.get("city", F.lit(0)).alias("city"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name AS name FROM nation")
def stdin_source(spark, sf_dir):
    """The nations' lines, handed over one by one."""
    doc = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name")))
    lines = (r[0] for r in table(spark, sf_dir, "nation").select(doc).toLocalIterator())
    return readers.read_stdin(spark, lines).select("doc_id", F.get("name", F.lit(0)).alias("name"))


# the store


def changed_store(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """A store of all places after a feed: of each five places one is deleted, one updated twice, one put, one under an unknown action."""
    docs = places(spark, sf_dir)
    store = DocumentStore(spark, folder(spark))
    store.apply(docs)
    turn = F.expr("cast(doc_id as bigint) % 5")
    action = F.when(turn == 0, "delete").when(turn == 1, "update").when(turn == 2, "index").otherwise("other")
    feed = docs.where(turn < 4).withColumns({"action": action, "arrival": F.lit(1), "importance": F.lit(0.25)})
    again = docs.where(turn == 1).withColumns({"action": F.lit("update"), "arrival": F.lit(2), "importance": F.lit(0.75)})
    store.apply(feed.unionByName(again))
    return store


STORE_SQL = f"WITH {PLACES_SQL}, st AS (SELECT doc_id, city, CASE key % 5 WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE importance END AS importance FROM places WHERE key % 5 <> 0)"


@query(f"{STORE_SQL} SELECT doc_id, city, round(importance, 10) AS importance FROM st")
def store_changes(spark, sf_dir):
    return changed_store(spark, sf_dir).read().select("doc_id", F.get("city", F.lit(0)).alias("city"), rounded("importance").alias("importance"))


@query(f"{STORE_SQL} SELECT doc_id, city FROM st WHERE doc_id IN ('1', '2', '3', '5')")
def store_get(spark, sf_dir):
    """By id; of these one is deleted, and one never was."""
    found = changed_store(spark, sf_dir).get("1", "2", "3", "5", "no such id")
    return found.select("doc_id", F.get_json_object("doc", "$.city[0]").alias("city"))


@query("SELECT count(*) AS stored, CAST(0 AS BIGINT) AS versions FROM customer")
def store_reset(spark, sf_dir):
    store = DocumentStore(spark, folder(spark))
    stored = store.apply(places(spark, sf_dir)).agg(F.count("*").alias("stored")).first()[0]
    store.reset()
    return spark.range(1).select(F.lit(stored).cast("long").alias("stored"), F.lit(len(store.versions())).cast("long").alias("versions"))


# what a delete takes out of each table

GONE, LEFT_SQL = "cast(doc_id as bigint) % 50 <> 0", "CAST(doc_id AS BIGINT) % 50 = 0"
LEFT_STATS = POSTINGS_SQL.rpartition("stats AS")[0] + f"kept AS (SELECT * FROM postings WHERE {LEFT_SQL}), stats AS (SELECT token, count(*) AS df FROM kept GROUP BY token)"


def after_delete(spark: SparkSession, sf_dir: str) -> ix.Index:
    docs = places(spark, sf_dir)
    return ix.apply_changes(ix.build(docs), docs.where(GONE).withColumn("action", F.lit("delete")))


@query(f"WITH {PLACES_SQL}, {CELLS_SQL} SELECT doc_id, {HASH_SQL.format('x', 'y')} AS geohash FROM c WHERE {LEFT_SQL}")
def index_delete_cells(spark, sf_dir):
    return after_delete(spark, sf_dir).geo_cells.select("doc_id", "geohash")


@query(f"WITH {PLACES_SQL}, f AS (SELECT 'type' AS name, type AS value, doc_id FROM places UNION ALL SELECT 'postcode', postcode, doc_id FROM places UNION ALL SELECT DISTINCT 'type', 'housenumber', doc_id FROM hns) SELECT * FROM f WHERE {LEFT_SQL}")
def index_delete_filters(spark, sf_dir):
    return after_delete(spark, sf_dir).filters.select("name", "value", "doc_id")


@query(f"WITH {LEFT_STATS}, {PAIRS_SQL.replace('postings', 'kept')} SELECT token, other FROM pairs")
def index_delete_pairs(spark, sf_dir):
    return after_delete(spark, sf_dir).pairs


@query(f"WITH {LEFT_STATS}, {NGRAMS_SQL} SELECT prefix, token FROM ngrams")
def index_delete_ngrams(spark, sf_dir):
    return after_delete(spark, sf_dir).edge_ngrams


@query(f"""WITH {POSTINGS_SQL.rpartition('stats AS')[0]} now AS (SELECT token FROM postings UNION SELECT unnest(['renamed', 'quarter'])), stats AS (SELECT token FROM now), {NGRAMS_SQL} SELECT prefix, token FROM ngrams""")
def index_update_ngrams(spark, sf_dir):
    """An update that gives some places another name besides their own brings the prefixes of its words."""
    docs = places(spark, sf_dir)
    new = docs.where("cast(doc_id as bigint) % 5 = 0").withColumns({"action": F.lit("update"), "name": F.concat("name", F.array(F.lit("renamed quarter 12345")))})
    return ix.apply_changes(ix.build(docs), new).edge_ngrams.select("prefix", "token")


# preparation of queries


@query(f"SELECT doc_id, 'Query too long, ' || n || ' chars, limit is 200' AS message FROM (SELECT doc_id, length({FOLD.format('text')}) AS n FROM documents) WHERE n > 200")
def query_too_long(spark, sf_dir):
    # one row out of a list of one, so that the condition on the message does not fold the text again
    message = F.transform(F.array(text.fold(F.col("text"))), lambda t: text.too_long(t))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(message).alias("message"))
    return rows.where("message is not null")


@query("SELECT c_custkey, c_custkey % 4 < 3 AS looked_for, c_custkey % 4 = 1 AS enforced FROM customer")
def housenumber_checks(spark, sf_dir):
    """No filter on types, one on housenumbers, one on these and others, and one on others."""
    turn = F.col("c_custkey") % 4
    types = F.when(turn == 1, F.array(F.lit("housenumber"))).when(turn == 2, F.array(F.lit("street"), F.lit("housenumber"))).when(turn == 3, F.array(F.lit("street")))
    check, only = retrieve.housenumber_checks(types)
    return table(spark, sf_dir, "customer").select("c_custkey", check.alias("looked_for"), only.alias("enforced"))


@query(rf"""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), {TOK}) AS ts FROM part), w AS (SELECT p_partkey, ts, unnest(range(1, len(ts) + 1)) AS i FROM t)
SELECT p_partkey, i - 1 AS pos, unnest(string_split(CASE WHEN ts[i] IN ('small', 'red') THEN 'tiny thing' WHEN ts[i] = 'hot' THEN 'warm' ELSE ts[i] END, ' ')) AS tok FROM w""")
def synonym_file(spark, sf_dir):
    lines = ["# comments and lines without an arrow go", "small, red, => tiny thing", "hot => cold", " hot=>warm ", "large"]
    toks = text.analyze(F.col("p_name"), replace(EngineConfig(), synonyms=load_synonyms(lines)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(toks).alias("t")).select("p_partkey", F.col("t.pos").cast("long").alias("pos"), "t.tok")


def _prepared_sql(q: str) -> str:
    """Tokens longest first; those over the threshold are common; each list goes by frequency, then by that order."""
    words = lambda which, order: f"coalesce(string_agg(token, ' ' ORDER BY {order}) FILTER (WHERE NOT num AND {which}), '')"
    return rf"""WITH {POSTINGS_SQL}, low AS (SELECT key, min(CAST(number AS INTEGER)) AS hn FROM numbers GROUP BY key),
qs AS (SELECT key AS query_id, regexp_extract_all(lower({q}), {TOK}) AS ts FROM places LEFT JOIN low USING (key)), each AS (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM qs),
known AS (SELECT query_id, i, ts[i] AS token, i = 1 AND regexp_full_match(ts[i], '[0-9]+') AS num, i = len(ts) AS at_end FROM each), lim AS (SELECT greatest(5, count(*) // 10) AS most FROM places),
o AS (SELECT known.*, df, most, row_number() OVER (PARTITION BY query_id ORDER BY length(token) DESC, i) AS ord FROM known LEFT JOIN stats USING (token), lim)
SELECT query_id, {words('df <= most', 'df, ord')} AS meaningful, {words('df > most', 'df, ord')} AS common, {words('df IS NULL', 'ord')} AS not_found, coalesce(max(token) FILTER (WHERE num), '') AS housenumber,
  max(token) FILTER (WHERE at_end) AS last, CAST(ceil(count(*) FILTER (WHERE NOT num) * (2.0::DOUBLE / 3)) AS BIGINT) AS least_match FROM o GROUP BY query_id"""


def prepared(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """Preparation asks for statistics of tokens and, where there are centers, for cells: nothing else of an index is made."""
    at = folder(spark)
    places(spark, sf_dir).write.parquet(f"{at}/source")
    docs = spark.read.parquet(f"{at}/source")
    config = config_for(docs.count())
    index = ix.build(docs, config)
    index.token_stats.write.parquet(f"{at}/token_stats")
    engine = Engine(replace(index, token_stats=spark.read.parquet(f"{at}/token_stats")), config)
    s = Chain(engine.index, config, engine._keep()).prepare(place_queries(spark, sf_dir, kind, docs))
    words = lambda c: F.array_join(F.transform(c, lambda t: t["tok"]), " ")
    lists = [words("meaningful").alias("meaningful"), words("common").alias("common"), words("nof").alias("not_found")]
    return s.select("query_id", *lists, F.col("hn").alias("housenumber"), "last", F.col("least_match").cast("long").alias("least_match"))


@query(_prepared_sql("concat_ws(' ', hn, name, city)"))
def query_housenumber(spark, sf_dir):
    return prepared(spark, sf_dir, 3)


@query(_prepared_sql("concat_ws(' ', name, city, 'nowhere', postcode)"))
def query_tokens(spark, sf_dir):
    return prepared(spark, sf_dir, 7)


@query(f"WITH {POSTINGS_SQL} SELECT token, df < 10 AS dry, df >= 100 AS overflow, df >= 10 AND df < 100 AS enough FROM stats")
def bucket_states(spark, sf_dir):
    """A bucket of all documents of each token against a limit of ten results."""
    index = _index(spark, sf_dir)
    chain = Chain(index, EngineConfig(), None)
    buckets = index.postings.groupBy("token").agg(F.collect_list("doc_id").alias("bucket")).withColumn("wanted", F.lit(10))
    state: dict[str, Column] = {"dry": chain.dry(), "overflow": chain.overflow(), "enough": chain.full()}
    return buckets.select("token", *[c.alias(name) for name, c in state.items()])
