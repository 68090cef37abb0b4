"""Batch search against one query at a time, on places and on a small handmade corpus."""

import json
import os
from dataclasses import replace

import pytest
from paths import SMALL

from brute import Brute
from wayfind.config import EngineConfig
from wayfind.plans import queries as registered
from wayfind.plans.places import config_for, place_queries, places
from wayfind.plans.search import Engine, QueryTooLong
from wayfind.sources.readers import read_stdin
from wayfind.sources.sinks import collections, not_found_log, query_log


def plain(d):
    out = {k: d[k] for k in ("doc_id", "type", "name", "street", "postcode", "city", "context", "importance", "lat", "lon")}
    out["housenumbers"] = {k: {"raw": h.raw, "lat": h.lat, "lon": h.lon, **(h.payload or {})} for k, h in (d["housenumbers"] or {}).items()}
    return out


def compare(engine, queries):
    """queries: dicts by id."""
    docs = [plain(d.asDict()) for d in engine.index.documents.collect() if d.name and any(d.name)]
    brute = Brute(docs, engine.config)
    rows = engine.queries([{**q, "query_id": i} for i, q in queries.items()])
    got = {i: [] for i in queries}
    for r in engine.search(rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 9), r.label))
    for i, q in queries.items():
        want = [(d, round(s, 9), label) for d, s, label in brute(**q)]
        assert got[i] == want, (i, q, got[i][:3], want[:3])
    return got


def test_places(spark):
    docs = places(spark, SMALL)
    engine = Engine.of_documents(docs, config_for(docs.count()))
    queries = {r.query_id: {k: r[k] for k in ("q", "lat", "lon", "limit", "autocomplete", "fuzzy", "filters")} for r in place_queries(spark, SMALL).collect()}
    n = max(queries)
    some = [q for q in queries.values() if len((q["q"] or "").split()) > 2]
    for i, q in enumerate(some[:25]):
        words = q["q"].split()
        queries[n + 1 + 4 * i] = {**q, "limit": 3, "autocomplete": True, "q": q["q"][:-2]}
        queries[n + 2 + 4 * i] = {**q, "lat": 48.0 + i / 997, "lon": 2.0 + i * 7919 % 1009 / 1009, "q": " ".join(words[:2])}
        queries[n + 3 + 4 * i] = {**q, "filters": {"type": ["building", "housenumber"]}, "q": " ".join(reversed(words))}
        queries[n + 4 + 4 * i] = {**q, "fuzzy": i % 2 == 0, "limit": 120, "q": words[0][:-1] + "x " + " ".join(words[1:]) + " zzz"}
    got = compare(engine, queries)
    assert sum(map(bool, got.values())) > 0.8 * len(got)


def of_brute(spark, queries, at=SMALL):
    """query_id, rank, doc_id, label and score of each query's results over the places."""
    docs = places(spark, at).collect()
    brute = Brute([plain(d.asDict()) for d in docs], config_for(len(docs)))
    out = []
    for q in queries.collect():
        found = brute(**{k: q[k] for k in ("q", "lat", "lon", "limit", "autocomplete", "fuzzy", "filters")})
        out += [(q.query_id, i + 1, d, label, s) for i, (d, s, label) in enumerate(found)]
    return out


def agree(rows, want):
    got, want = sorted(tuple(r) for r in rows), sorted(want)
    assert got and [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1e-9)


KINDS = "search_meaningful search_fuzzy search_autocomplete search_housenumber search_filtered search_geo_bias search_only_commons search_reduce_tokens".split()


@pytest.mark.parametrize("name,kind", [(name, kind) for kind, name in enumerate(KINDS)])
def test_registered_kinds(spark, name, kind):
    """A query of the kind for every place."""
    agree(registered.queries()[name](spark, SMALL).collect(), of_brute(spark, place_queries(spark, SMALL, kind)))


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The small tables with every customer twice, under a key of its own."""
    at = str(tmp_path_factory.mktemp("doubled"))
    for t in ("nation", "region", "part", "orders"):
        os.symlink(f"{SMALL}/{t}.parquet", f"{at}/{t}.parquet")
    c = spark.read.parquet(f"{SMALL}/customer.parquet")
    c.unionByName(c.withColumn("c_custkey", c.c_custkey + c.count())).write.parquet(f"{at}/customer.parquet")
    return at


def test_registered_search_takes_every_place(spark, doubled):
    asked = place_queries(spark, doubled)
    assert asked.count() == places(spark, doubled).count() == 2 * places(spark, SMALL).count()
    agree(registered.queries()["search_full"](spark, doubled).collect(), of_brute(spark, asked, doubled))


def test_registered_candidates_take_every_place(spark):
    got = {r.query_id for r in registered.queries()["search_candidates"](spark, SMALL).select("query_id").distinct().collect()}
    assert got >= {q for q, *_ in of_brute(spark, place_queries(spark, SMALL))}


CORPUS = [
    {"_id": "1", "type": "street", "name": "rue des Lilas", "city": "Andrésy", "postcode": "78570", "lat": 48.32545, "lon": 2.2565, "importance": 0.2, "housenumbers": {"1": {"lat": 48.3255, "lon": 2.2566, "key": "abc", "postcode": "78571"}, "3 bis": {"lat": 48.33, "lon": 2.26}}},
    {"_id": "2", "type": "street", "name": ["avenue de Paris", "Cours de Paris"], "city": "Lyon", "postcode": "69000", "lat": "45.1", "lon": "4.2", "foo": "bar"},
    {"_id": "3", "type": ["city", "municipality"], "name": "Paris", "postcode": ["75000", "75001"], "lat": 48.85, "lon": 2.35, "importance": 1},
    {"_id": "4", "type": "street", "name": "rue de la Monnaie", "city": "Vitry", "lat": 48.80, "lon": 2.40, "importance": 0.1},
    {"_id": "5", "type": "street", "name": "rue de la Monnaie", "city": "Paris", "lat": 48.86, "lon": 2.34, "importance": 0.9},
    {"_id": "6", "type": "street", "name": "rue de la Monnaie", "city": "Condom", "lat": 43.95, "lon": 0.37},
    {"_id": "7", "type": "street", "name": "La monnaye", "city": "Saint-Loup-Cammas", "lat": 43.70, "lon": 1.48},
    {"_id": "8", "type": "street", "name": "rue du 8 Mai", "city": "Troyes", "lat": 48.3, "lon": 4.07, "housenumbers": {"3": {"lat": 48.31, "lon": 4.08}, "8": {"lat": 48.32, "lon": 4.09}}},
    {"_id": "9", "type": "street", "lat": 1, "lon": 1},
    {"_id": "10", "type": "locality", "name": "Erispœ", "city": "Brest", "lat": 48.39, "lon": -4.48},
    {"_id": "11", "type": "street", "name": {"nested": 1}, "lat": 1, "lon": 1},
]


@pytest.fixture(scope="module")
def small(spark):
    lines = [json.dumps(d) for d in CORPUS] + ["no json", "[1]", ""]
    return Engine.of_documents(read_stdin(spark, lines), replace(EngineConfig(), common_threshold=3, intersect_limit=4))


def test_small_corpus(small):
    texts = ["rue des lilas", "RUE DES LILAS", "lilas andresy", "1 rue des lilas", "3 bis rue des lilas", "rue des lila", "lials", "pariss", "avenu de paris", "paris", "rue de la monnaie", "rue de la monnaie paris", "rue de la", "la monnaie vitry", "8 rue du 8 mai troyes", "3 rue du 8 mai troyes", "rue du 8 mai troyes", "erispoe", "Erispœ brest", "zzz", "", "  ?! ", "75001", "rue", "cours de paris lyon nowhere", "condom monnaie lilas", "8", "bar"]
    queries = {i: {"q": q} for i, q in enumerate(texts)}
    n = len(texts)
    more = [{"q": "par", "autocomplete": True}, {"q": "rue de la mon", "autocomplete": True}, {"q": "rue de la monnaie", "lat": 43.95, "lon": 0.37}, {"q": "rue", "lat": 43.95, "lon": 0.37}, {"q": "8", "lat": 48.32, "lon": 4.09}, {"q": "8", "lat": 48.32, "lon": 4.09, "filters": {"type": ["street"]}},
            {"q": "paris", "filters": {"type": ["city"]}}, {"q": "paris", "filters": {"type": ["street", "city"], "postcode": ["69000", "75001"]}}, {"q": "rue des lilas", "filters": {"type": ["housenumber"]}}, {"q": "1 rue des lilas", "filters": {"type": ["housenumber"]}}, {"q": "1 rue des lilas", "filters": {"type": ["street"]}}, {"q": "1 rue des lilas", "filters": {"type": ["street", "housenumber"]}}, {"q": "pariss", "filters": {"type": ["city"]}}, {"q": "rue de la", "filters": {"type": ["street"]}}, {"q": "monnai", "fuzzy": False}, {"q": "rue", "limit": 2}]
    queries |= {n + i: q for i, q in enumerate(more)}
    got = compare(small, queries)
    ids = {q["q"]: [d for d, *_ in got[i]] for i, q in queries.items() if len(q) == 1}
    assert ids["rue des lilas"][0] == ids["lilas andresy"][0] == ids["rue des lila"][0] == "1"
    assert ids["rue de la monnaie"][0] == "5" and ids["erispoe"] == ["10"] and ids["zzz"] == ids[""] == []
    assert got[3][0][2] == "1 rue des Lilas 78571 Andrésy"


def test_housenumbers_of_a_street_with_a_number_in_its_name(small):
    rows = small.queries([{"q": "rue du 8 mai troyes"}, {"q": "8 rue du 8 mai troyes"}, {"q": "3 rue du 8 mai troyes"}])
    got = {r.query_id: r.housenumber for r in small.search(rows).where("rank = 1").collect()}
    assert got == {0: None, 1: "8", 2: "3"}


def test_geojson_and_logs(small):
    rows = small.queries([{"q": "1 rue des lilas", "limit": 1, "lat": 48.3, "lon": 2.2, "filters": {"type": ["street", "housenumber"]}}, {"q": "avenue de paris lyon", "limit": 1}, {"q": "zzz"}])
    found = small.search(rows, whole=True)
    out = {r.query_id: json.loads(r.geojson) for r in collections(found, rows, small.config).collect()}
    first = out[0]["features"][0]
    assert first["properties"]["name"] == "1 rue des Lilas" and first["properties"]["street"] == "rue des Lilas" and first["properties"]["type"] == "housenumber"
    assert first["properties"]["key"] == "abc" and first["properties"]["postcode"] == "78571" and isinstance(first["properties"]["distance"], int)
    assert first["geometry"] == {"type": "Point", "coordinates": [2.2566, 48.3255]}
    assert out[0]["center"] == [2.2, 48.3] and out[0]["limit"] == 1 and out[0]["filters"] == {"type": ["street", "housenumber"]}
    second = out[1]["features"][0]["properties"]
    assert second["foo"] == "bar" and second["label"] == "avenue de Paris 69000 Lyon" and second["street"] == "avenue de Paris" and "key" not in second
    assert out[2]["features"] == [] and out[2]["query"] == "zzz" and out[2]["type"] == "FeatureCollection"
    lines = {r.query_id: r.line for r in query_log(found, rows).collect()}
    assert lines[2] == "zzz\t-\t-" and lines[1].startswith("avenue de paris lyon\tavenue de Paris 69000 Lyon\t0.")
    assert [r.line for r in not_found_log(found, rows).collect()] == ["zzz"]


def test_long_queries_are_refused(small):
    short = Engine(small.index, replace(small.config, query_max_length=10))
    with pytest.raises(QueryTooLong, match="Query too long, 16 chars, limit is 10"):
        short.search(short.queries([{"q": "this is too long"}]))


def points(spark, *rows):
    return spark.createDataFrame([(i, lat, lon, limit, f) for i, (lat, lon, limit, f) in enumerate(rows)], "query_id long, lat double, lon double, limit int, filters map<string,array<string>>")


def test_reverse(small, spark):
    p = points(spark, (48.3255, 2.2566, None, {}), (48.32545, 2.2565, 1, {"type": ["street"]}), (48.32545, 2.2565, 1, {"type": ["housenumber"]}), (10.0, 10.0, 5, {}), (48.32545, 2.2565 + 0.0028, 1, {}), (48.86, 2.34, 5, {"type": ["city"]}))
    got = {}
    for r in small.reverse(p).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.housenumber, r.d_type))
    assert got == {0: [("1", "1", "housenumber")], 1: [("1", None, "street")], 2: [("1", "1", "housenumber")], 4: [("1", "1", "housenumber")]}


def test_http(small):
    from wayfind.http import App

    app = App(Engine(small.index, replace(small.config, query_max_length=30)))

    def get(path, query=""):
        seen = {}
        body = b"".join(app({"PATH_INFO": path, "QUERY_STRING": query}, lambda s, h: seen.update(status=s, headers=dict(h))))
        return seen["status"][:3], json.loads(body), seen["headers"]

    status, body, headers = get("/search/", "q=1,%20rue%20des%20lilas&type=street%20housenumber&lat=48.3&lng=2.2")
    assert status == "200" and headers["Access-Control-Allow-Origin"] == "*" and body["features"][0]["properties"]["label"].startswith("1 rue")
    assert body["filters"] == {"type": ["street", "housenumber"]} and body["limit"] == 5 and body["query"] == "1, rue des lilas"
    assert get("/search")[0] == "400" and get("/reverse", "lat=1")[0] == "400" and get("/nowhere")[0] == "404"
    assert get("/search", "q=x&lat=invalid&lon=3")[1]["description"] == 'The "lat" parameter is invalid. invalid value'
    assert get("/search", "q=x&longitude=200&lat=3")[1]["description"] == 'The "lon" parameter is invalid. out of range'
    assert get("/search", "q=x&limit=101")[0] == "400"
    assert get("/search", "q=" + "x" * 31)[0] == "413"
    assert get("/reverse", "lat=48.32545&lon=2.2565")[1]["features"][0]["properties"]["label"]
    assert get("/health")[1]["status"] == "HEALTHY"


def test_shell(small):
    from wayfind.shell import Shell, parse_filters, parse_query

    assert parse_filters("rue TYPE street LIMIT 10") == ("rue  LIMIT 10", {"type": "street"})
    assert parse_filters("rue TYPE street TYPE city")[1] == {"type": ["street", "city"]}
    assert parse_filters("rue TYPE=street||city POSTCODE 75000")[1] == {"type": ["street", "city"], "postcode": "75000"}
    got = parse_query("rue CENTER 48.1 2.2 LIMIT 3 AUTOCOMPLETE 0 TYPE city")
    assert (got["q"], got["lat"], got["lon"], got["limit"], got["autocomplete"], got["filters"]) == ("rue", 48.1, 2.2, 3, False, {"type": "city"})
    shell = Shell(small)
    assert shell.run("BESTSCORE monnaie").count() == 3 and shell.run("FREQUENCY Lilas").first().df == 1
    assert [r.other for r in shell.run("PAIR lilas").collect()] == ["78570", "andresy", "des", "rue"]
    assert {r.token for r in shell.run("AUTOCOMPLETE monn").collect()} == {"monnaie", "monnaye"}
    assert [r.token for r in shell.run("FUZZYINDEX monnaue").collect()] == ["monnaie", "monnaye"]
    assert shell.run("GEOHASH 48.32545 2.2565").first().geohash == "u09dgm7" and shell.run("GEOHASH 49.32545 4.2565").first().geohash == "u0g08g7"
    assert {r.doc_id for r in shell.run("GEOHASHMEMBERS u09dgm7").collect()} == {"1"}
    assert shell.run("GEODISTANCE 1 48.32545 2.2565").first().km == 0
    assert json.loads(shell.run("GEOHASHTOGEOJSON 48.32545 2.2565 NEIGHBORS 1").first().geojson)["type"] == "Polygon"
    assert [r.tok for r in shell.run("TOKENIZE Rue des Lilas").collect()] == ["rue", "des", "lilas"]
    assert shell.run("STRDISTANCE rue des lilas|rue des lilas").first().similarity == pytest.approx(1.0)
    assert shell.run("INTERSECT rue monnaie LIMIT 1").count() == 2
    assert [h.key for h in shell.run("GET 8").first().housenumbers] == ["3", "8"]
    assert shell.run("INDEX 1").where("token = 'lilas'").first().rank == 1
    assert shell.run("DBINFO")["documents"] == 10 and shell.run("CONFIG min_score") == 0.1
    assert shell.run("EXPLAIN rue des lilas").first().doc_id == "1" and shell.run("BUCKET monnaie").count() == 3
    assert shell.run("REVERSE 48.86 2.34 LIMIT 2").first().doc_id == "5"
