import json

import pytest
from pyspark.sql import functions as F

from wayfind.config import EngineConfig, FieldSpec, load_config, load_synonyms
from wayfind.operators import index as ix
from wayfind.operators import retrieve
from wayfind.plugins import Plugins
from wayfind.sources import readers
from wayfind.sources.store import DocumentStore, merge

DOC = {"_id": "a", "type": "street", "name": "rue des Lilas", "city": "Andrésy", "lat": "48.32545", "lon": "2.2565", "importance": 0.5, "housenumbers": {"1": {"lat": "48.325451", "lon": "2.25651"}}}
DOC2 = {"_id": "b", "type": "street", "name": "rue des Lilas", "city": "Paris", "lat": 49.32545, "lon": 4.2565, "housenumbers": {"1": {"lat": 48.325451, "lon": 2.25651}, "3 Bis": {"lat": 1, "lon": 2, "key": "v"}}}


def docs(spark, *rows, config=EngineConfig()):
    return readers.read_stdin(spark, [json.dumps(r) for r in rows], config)


def boosts(df):
    return {(r.token, r.doc_id): r.boost for r in df.collect()}


def test_postings(spark):
    got = boosts(ix.postings(docs(spark, DOC)))
    assert got == {(t, "a"): pytest.approx(v) for t, v in {"rue": 4.05 / 3, "des": 4.05 / 3, "lilas": 4.05 / 3, "andresy": 1.05}.items()}


def test_a_token_keeps_its_best_boost_over_aliases(spark):
    got = boosts(ix.postings(docs(spark, {"_id": "v", "name": ["Vernou-la-Celle-sur-Seine", "Vernou"], "lat": 1, "lon": 1})))
    assert got["vernou", "v"] == 4 and got["celle", "v"] == 4 / 5


def test_boosts_may_follow_the_document(spark):
    got = boosts(ix.postings(docs(spark, {"_id": "m", "type": "municipality", "name": "x", "postcode": "77000", "lat": 1, "lon": 1}, {"_id": "s", "type": "street", "name": "x", "postcode": "77000", "lat": 1, "lon": 1})))
    assert got["77000", "m"] == 1.2 and got["77000", "s"] == 1
    config = EngineConfig(extra_fields=(FieldSpec("context", lambda: F.when(F.array_contains("type", "street"), 9.0).otherwise(2.0)),))
    got = boosts(ix.postings(docs(spark, {"_id": "s", "type": "street", "name": "x", "context": "y", "lat": 1, "lon": 1}, config=config), config))
    assert got["y", "s"] == 9


def test_cells_filters_and_housenumbers(spark):
    built = ix.build(docs(spark, DOC, DOC2))
    assert {(r.geohash, r.doc_id) for r in built.geo_cells.collect()} >= {("u09dgm7", "a"), ("u09dgm7", "b"), ("u0g08g7", "b")}
    assert {(r.name, r.value, r.doc_id) for r in built.filters.collect()} == {(n, v, d) for d in "ab" for n, v in (("type", "street"), ("type", "housenumber"))}
    numbers = {r.doc_id: r.housenumbers for r in built.documents.collect()}
    assert numbers["b"]["3bis"].raw == "3 Bis" and numbers["b"]["3bis"].payload == {"key": "v"} and numbers["a"]["1"].lat == 48.325451


def test_numbers_have_no_edge_ngrams(spark):
    built = ix.build(docs(spark, {"_id": "x", "name": "2828 Lilas", "city": "Paris", "lat": 1, "lon": 1}))
    assert {r.prefix for r in built.edge_ngrams.collect()} == {"lil", "lila", "par", "pari"}


def test_pairs_are_symmetric_and_irreflexive(spark):
    got = {(r.token, r.other) for r in ix.build(docs(spark, DOC)).pairs.collect()}
    words = {"rue", "des", "lilas", "andresy"}
    assert got == {(a, b) for a in words for b in words if a != b}


def test_documents_without_a_name_leave_nothing(spark):
    built = ix.build(docs(spark, {"_id": "n", "type": "street", "city": "Paris", "lat": 1, "lon": 1}, {"_id": "e", "name": "", "lat": 1, "lon": 1}))
    assert built.documents.count() == 2 and not built.postings.count() and not built.geo_cells.count() and not built.filters.count()


def tables(index):
    names = ("postings", "token_stats", "pairs", "edge_ngrams", "geo_cells", "filters")
    return {n: sorted(map(str, (r.asDict() for r in getattr(index, n).select(*sorted(getattr(index, n).columns)).collect()))) for n in names}


def test_changes_give_what_building_anew_gives(spark):
    third = {"_id": "c", "type": "city", "name": "Paris", "lat": 48.8, "lon": 2.3}
    changes = [{**DOC, "_action": "delete"}, {**third, "_action": "update", "name": "Lutèce rue"}, {"_id": "d", "name": "Nouveau", "lat": 1, "lon": 2, "_action": "index"}, {"_id": "b", "_action": "other", "name": "no"}]
    changed = ix.apply_changes(ix.build(docs(spark, DOC, DOC2, third)), docs(spark, *changes))
    fresh = ix.build(docs(spark, DOC2, {**third, "name": "Lutèce rue"}, {"_id": "d", "name": "Nouveau", "lat": 1, "lon": 2}))
    assert tables(changed) == tables(fresh)
    assert {r.doc_id for r in changed.documents.collect()} == {"b", "c", "d"}


def test_index_is_written_and_read(spark, tmp_path):
    built = ix.build(docs(spark, DOC, DOC2))
    built.write(str(tmp_path / "i"))
    assert tables(ix.Index.read(spark, str(tmp_path / "i"))) == tables(built)


def test_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    assert store.read() is None
    store.apply(docs(spark, DOC, DOC2))
    store.apply(docs(spark, {**DOC, "_action": "delete"}, {**DOC2, "name": "new", "_action": "update"}))
    assert [(r.doc_id, r.name) for r in store.read().collect()] == [("b", ["new"])] and store.get("a", "b").count() == 1
    store.reset()
    assert store.read() is None


def test_last_change_counts(spark):
    rows = docs(spark, {"_id": "a", "name": "1", "n": 1}, {"_id": "a", "name": "2", "n": 2, "_action": "delete"}).withColumn("at", F.get_json_object("doc", "$.n"))
    assert merge(rows.drop("at").limit(0), rows, "at").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;city;somethingelse\n"rue; des Lilas";Paris;x\nb;Lyon;y\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert {(r.name[0], r.city[0], json.loads(r.doc)["somethingelse"]) for r in got} == {("rue; des Lilas", "Paris", "x"), ("b", "Lyon", "y")}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(DOC), "nope", "", '{"name": [["nested"]]}', '{"name": "no id", "lat": 1, "lon": 1}']))
    got = {r.name[0]: r.doc_id for r in readers.read_json_lines(spark, str(tmp_path / "a.json")).collect()}
    assert got["rue des Lilas"] == "a" and len(got) == 2 and len(got["no id"]) == 16


def test_filters(spark):
    q = spark.createDataFrame([({"type": [" b", "a", "b", ""], "postcode": [" "]},)], "f map<string,array<string>>")
    assert q.select(retrieve.filter_groups(F.col("f"))).first()[0] == [["type=a", "type=b"]]
    many = spark.createDataFrame([([f"v{i:02}" for i in range(12)],)], "v array<string>")
    assert many.select(retrieve.normalize_filter(F.col("v"))).first()[0] == [f"v{i:02}" for i in range(10)]


def test_housenumber_checks(spark):
    df = spark.createDataFrame([(None,), (["street"],), (["housenumber"],), (["housenumber", "street"],)], "t array<string>")
    assert [tuple(r) for r in df.select(*retrieve.housenumber_checks(F.col("t"))).collect()] == [(True, False), (False, False), (True, True), (True, False)]


def test_feed(spark, tmp_path):
    from wayfind.streaming.feed import apply_feed, current

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps(DOC) + "\n" + json.dumps(DOC2))

    def run():
        lines = spark.readStream.text(str(tmp_path / "in"))
        apply_feed(lines, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination(120)

    run()
    (tmp_path / "in/2.json").write_text(json.dumps({**DOC, "_action": "delete"}) + "\nbroken")
    run()
    assert {r.doc_id for r in current(spark, str(tmp_path / "index")).postings.collect()} == {"b"}


def test_changes_count_in_order_of_arrival(spark, tmp_path):
    """delete then index keeps a document, index then delete does not, whatever their JSON; in files, standard input and the feed."""
    from wayfind.sources.store import DocumentStore
    from wayfind.streaming.feed import apply_feed, current

    lines = [{**DOC, "_id": "x", "_action": "delete"}, {**DOC, "_id": "x", "name": "back again"}, {**DOC, "_id": "y", "name": "zz"}, {**DOC, "_id": "y", "name": "aa", "_action": "update"}, {**DOC, "_id": "z"}, {**DOC, "_id": "z", "_action": "delete"}]
    for k, order in enumerate((lines, lines[::-1])):
        last = {x["_id"]: x for x in order}
        want = sorted((i, x["name"] if isinstance(x["name"], str) else x["name"][0]) for i, x in last.items() if x.get("_action") != "delete")
        at = tmp_path / str(k)
        (at / "in").mkdir(parents=True)
        (at / "in/1.json").write_text("\n".join(map(json.dumps, order)))
        for name, changes in (("file", readers.read_json_lines(spark, str(at / "in/1.json"))), ("stdin", readers.read_stdin(spark, map(json.dumps, order)))):
            stored = DocumentStore(spark, str(at / name)).apply(changes)
            assert "arrival" not in stored.columns and sorted((r.doc_id, r.name[0]) for r in stored.collect()) == want
        apply_feed(spark.readStream.text(str(at / "in")), str(at / "index"), str(at / "checkpoint")).awaitTermination(120)
        assert sorted((r.doc_id, r.name[0]) for r in current(spark, str(at / "index")).documents.collect()) == want


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from wayfind import __main__ as cli
    from wayfind.operators.index import Index

    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    home = str(tmp_path / "home")
    assert cli.main(["--home", home, "batch", str(tmp_path / "none.json")]) == 1 and "no such file" in capsys.readouterr().err
    assert cli.main(["--home", home, "batch", "--no-ngrams", str(tmp_path / "a.json")]) == 0
    assert Index.read(spark, f"{home}/index").edge_ngrams.count() == 0
    assert cli.main(["--home", home, "ngrams"]) == 0
    assert Index.read(spark, f"{home}/index").edge_ngrams.where("prefix = 'lil'").count() == 1


def test_settings_of_plugins_come_before_the_file(tmp_path):
    (tmp_path / "c.py").write_text("BUCKET_MAX = 50\n")
    got = load_config(str(tmp_path / "c.py"), env={}, defaults={"bucket_max": 7, "min_score": 0.5})
    assert (got.bucket_max, got.min_score) == (50, 0.5)


def test_config(tmp_path):
    (tmp_path / "syn").write_text("# c\ncba => abc\nxzy, zyx, => xyz\n")
    (tmp_path / "c.py").write_text(f"BUCKET_MAX = 50\nFILTERS = ['type']\nSYNONYMS_PATH = {str(tmp_path / 'syn')!r}\nlower = 1\n")
    got = load_config(str(tmp_path / "c.py"), {"WAYFIND_MIN_SCORE": "0.2", "WAYFIND_FILTERS": "a, b", "WAYFIND_BUCKET_MIN": "7"}, query_max_length=9)
    assert (got.bucket_max, got.min_score, got.filters, got.bucket_min, got.query_max_length) == (50, 0.2, ("a", "b"), 7, 9)
    assert got.synonyms == {"cba": "abc", "xzy": "xyz", "zyx": "xyz"} == load_synonyms(["cba=>abc", "xzy,zyx=>xyz"])
    assert (EngineConfig().name_field, EngineConfig().housenumbers_field) == ("name", "housenumbers")


def test_plugins():
    class One:
        __name__ = "one"

        def configure(self, config):
            return config + 1

    plugins = Plugins()
    plugins.register(One(), "one")
    assert plugins.call("configure", 1) == [2] and plugins.call("register_command", None) == []
    plugins.block("one")
    with pytest.warns(UserWarning):
        plugins.register(One(), "one")
    assert plugins.call("configure", 1) == []
    with pytest.raises(ValueError):
        plugins.call("nothing")
