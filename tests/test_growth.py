"""Work that goes by what differs in a batch, not by how many ask for it."""

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from wayfind.operators import index as ix
from wayfind.operators import retrieve
from wayfind.plans import queries as registered
from wayfind.plans.collect import Chain
from wayfind.plans.places import config_for, places
from wayfind.plans.search import Engine


def most_rows(df):
    """The most rows that a step of df's plan makes when run."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        rows = plan.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    built = ix.build(places(spark, SMALL))
    built.write(path, 2)
    return ix.Index.read(spark, path)


def repeated(spark, times):
    """Two different attempts, one for each odd and one for each even query."""
    toks = F.when(F.col("id") % 2 == 0, F.array(F.lit("small"), F.lit("ring"))).otherwise(F.array(F.lit("ring"), F.lit("small"), F.lit("ring")))
    return spark.range(times).select(F.col("id").alias("query_id"), F.lit(0).alias("no"), toks.alias("toks"), F.lit(False).alias("geo"), F.array().cast("array<array<string>>").alias("fl"), F.lit(10).alias("cap"), F.lit(5).alias("wanted"))


def test_equal_scans_are_made_once(spark, index):
    some = index.postings.count()
    found = retrieve.manual_scan(index, repeated(spark, 200), rows=51)
    assert most_rows(found) <= max(some, 200 * 5)
    one = lambda q: sorted(r.doc_id for r in found.where(f"query_id = {q}").collect())
    assert one(0) == one(198) != [] and one(1) == one(199) != []


def test_equal_intersections_are_made_once(spark, index):
    some = index.postings.count()
    found = retrieve.intersect_once(index, repeated(spark, 200), most=10)
    assert most_rows(found) <= max(some, 200 * 10)
    plain = retrieve.intersect(index, repeated(spark, 2), most=10).drop("no")
    rows = lambda df: sorted((r.query_id % 2, r["rank"], r.doc_id, r.boost) for r in df.collect())
    assert rows(found.drop("no").where("query_id < 2")) == rows(plain) == rows(found.drop("no").where("query_id >= 198"))


def test_registered_intersections_are_made_once(spark, monkeypatch):
    seen = []
    real = retrieve.intersect

    def counted(index, attempts, *a, **b):
        seen.append(attempts.count())
        return real(index, attempts, *a, **b)

    monkeypatch.setattr(retrieve, "intersect", counted)
    names = places(spark, SMALL).select("name").distinct().count()
    registered.queries()["zinter_topk"](spark, SMALL)
    registered.queries()["zinter_filtered"](spark, SMALL)
    assert seen[0] <= names and seen[1] <= names * 5


def test_postings_are_made_within_documents(spark, index):
    """No aggregation, so no sort or hash table of all postings in a task."""
    made = ix.postings(index.documents)
    assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Aggregate", "Sort", "Exchange"))
    assert sorted(map(str, made.collect())) == sorted(map(str, index.postings.select(*made.columns).collect()))


@pytest.fixture(scope="module")
def asked(index):
    """An engine, and four queries, two of them different."""
    engine = Engine(index, config_for(index.documents.count()))
    return engine, engine.queries([{"query_id": 9 - i, "q": "small ring" if i % 2 else "hot bolt", "lat": 48.5, "lon": 2.5, "filters": {"type": ["building", "machinery"]}} for i in range(4)])


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score, r.label))
    return out


def test_equal_queries_are_answered_once(spark, asked, monkeypatch):
    engine, queries = asked
    seen, real = [], Chain.run

    def counted(self, each):
        seen.append(each.count())
        return real(self, each)

    monkeypatch.setattr(Chain, "run", counted)
    got = answers(engine.search(queries))
    assert seen == [2]
    assert set(got) == {6, 7, 8, 9} and got[6] == got[8] != got[7] == got[9]


def test_equal_points_are_answered_once(spark, asked, monkeypatch):
    engine, _ = asked
    points = engine.queries([{"query_id": i, "lat": 48.0001 + i % 2 / 997, "lon": 2.0001 + i % 2 * 7919 % 1009 / 1009, "limit": 3} for i in range(6)])
    seen, real = [], retrieve.near

    def counted(index, queries, *a, **b):
        seen.append(queries.count())
        return real(index, queries, *a, **b)

    monkeypatch.setattr(retrieve, "near", counted)
    got = answers(engine.reverse(points))
    assert seen[0] == 2
    assert len(got) == 6 and got[0] == got[2] == got[4] != got[1] == got[3] == got[5]


def test_long_texts_are_folded_once(spark):
    plan = registered.queries()["query_too_long"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" {2,}") == 1


def test_preparation_makes_no_index(spark, monkeypatch):
    """Places are computed once, and of the index only what preparation asks for."""
    from wayfind.plans import intake, search
    from wayfind.plans import places as pl

    calls = []

    def counted(*a):
        calls.append(a)
        return places(*a)

    def refuse(*a, **b):
        raise AssertionError("a table of the index that preparation does not ask for")

    monkeypatch.setattr(search, "build_at", refuse)
    monkeypatch.setattr(intake, "places", counted)
    monkeypatch.setattr(pl, "places", counted)
    for name in ("query_tokens", "query_housenumber"):
        assert registered.queries()[name](spark, SMALL).count() == places(spark, SMALL).count()
    assert len(calls) == 2


def test_near_centers_no_query_goes_through_postings(spark, index):
    """Attempts near a center begin at their close documents, of which each query here has two."""
    attempts = repeated(spark, 300).withColumn("geo", F.lit(True))
    some = [r.doc_id for r in index.postings.where("token = 'ring'").orderBy("doc_id").limit(2).collect()]
    close = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, some))).alias("doc_id"))
    found = retrieve.intersect(index, attempts, close, most=10)
    assert most_rows(found) <= max(index.postings.count(), 300 * 2 * 2)
    both = {r.doc_id for r in index.postings.where("token = 'small'").collect()} & {r.doc_id for r in index.postings.where("token = 'ring'").collect()}
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(q, d) for q in range(300) for d in some if d in both}


def test_attempts_that_begin_alike_share_their_first_documents(spark, index):
    """Many attempts of one rare token with all sorts of others: its documents meet only what they hold."""
    words = [r.token for r in index.token_stats.orderBy("df", "token").collect()]
    rows = [(q, 0, [words[0], w], False) for q, w in enumerate(words[1:])]
    fl = F.array().cast("array<array<string>>")
    attempts = spark.createDataFrame(rows, "query_id long, no int, toks array<string>, geo boolean").select("*", fl.alias("fl"), F.lit(10).alias("cap"))
    held = {}
    for r in index.postings.collect():
        held.setdefault(r.doc_id, set()).add(r.token)
    got = {(r.query_id, r.doc_id) for r in retrieve.intersect(index, attempts, most=10).collect()}
    want = {(q, d) for q, _, toks, _ in rows for d, t in held.items() if t >= set(toks)}
    assert {q for q, _ in got} == {q for q, _ in want} and got <= want
