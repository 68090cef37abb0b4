import pytest
from pyspark.sql import functions as F

from brute import fold, norm, sim, toks
from wayfind.config import EngineConfig
from wayfind.functions import geo, text


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


TEXTS = ["28 Boulevard des Capucines", "rue des Trois-Épis", "Erispœ", "Straße 12", "L'Île-d'Yeu", "x²½Ⅷ 日本 _a_", "Æther Ørsted Łódź Đà", "", "  ..  ", "ÀÉÎÕÜ ñ ç", "été"]


def test_analysis_is_that_of_plain_python(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for r in df.select("t", text.normalize(F.col("t")).alias("n"), text.fold(F.col("t")).alias("f"), F.transform(text.analyze(F.col("t")), lambda x: x["tok"]).alias("a")).collect():
        if r.t.isascii() or not set(r.t) & set("²½Ⅷ日本ÆØŁĐà"):
            assert (r.n, r.f) == (norm(r.t), fold(r.t))
        assert len(r.a) == len(toks(r.t))
    folded = dict(df.select("t", text.fold(F.col("t"))).collect())
    other = spark.createDataFrame([("Αθήνα",), ("Ψυχή",), ("Москва",), ("Щёлково",), ("東京 X",)], "t string")
    assert [r[0] for r in other.select(text.fold(F.col("t"))).collect()] == ["athena", "psukhe", "moskva", "shchelkovo", "東京 x"]
    assert folded["Æther Ørsted Łódź Đà"] == "aether orsted lodz da" and folded["Straße 12"] == "strasse 12" and folded["Erispœ"] == "erispoe"


def test_housenumber_is_a_leading_number(spark):
    kinds = lambda s: [t.kind for t in one(spark, text.analyze(F.col("t")), t=s)]
    assert kinds("12 rue 4") == ["housenumber", None, None] and kinds("rue 12") == [None, None] and kinds("12bis rue") == [None, None]


def test_synonyms(spark):
    config = EngineConfig(synonyms={"bd": "boulevard", "st": "saint louis"})
    out = one(spark, text.analyze(F.col("t"), config), t="Bd St")
    assert [(t.tok, t.raw, t.pos, t.sub) for t in out] == [("boulevard", "Bd", 0, 0), ("saint", "St", 1, 0), ("louis", "St", 1, 1)]


def test_query_length(spark):
    assert one(spark, text.too_long(F.col("t"), EngineConfig(query_max_length=10)), t="this is too long") == "Query too long, 16 chars, limit is 10"
    assert one(spark, text.too_long(F.col("t")), t="short") is None


def test_edge_ngrams(spark):
    grams = lambda s: one(spark, text.edge_ngrams(F.col("t")), t=s)
    assert grams("vanbrechi") == ["van", "vanb", "vanbr", "vanbre", "vanbrec", "vanbrech"]
    assert grams("abc") == grams("ab") == grams("") == [] and grams("abcd") == ["abc"]
    assert max(map(len, grams("a" * 40))) == 20


def test_fuzzy_neighbors(spark):
    words = lambda w, c=EngineConfig(): one(spark, text.fuzzy_neighbors(F.col("t"), c), t=w)
    plain = words("mot", EngineConfig(fuzzy_key_map=None))
    assert plain[:2] == ["omt", "mto"] and "mat" in plain and "mots" in plain and "mo" not in plain and len(plain) == len(set(plain)) == 2 + 3 * 25 + 4 * 26 - 3
    mapped = words("mot")
    assert mapped[:2] == ["omt", "mto"] and set(mapped[2:]) >= {"lot", "pot", "uot", "mit", "mor"} and "mat" in mapped and "mzt" not in mapped
    assert "ilas" in words("lilas") and words("")[:1] == ["a"]


def test_similarity(spark):
    df = spark.createDataFrame([("rue des lilas", "rue des lila"), ("a", "a"), ("a", "b"), ("aaaa", "aaa"), ("abab", "baba"), ("", "x"), ("x", ""), ("rue", "xyz"), ("le le le la", "le la le")], "a string, b string")
    for r in df.select("a", "b", text.bigram_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == sim(r.a, r.b), r
    better = one(spark, text.string_similarity(F.lit("rue des lilas"), F.col("t")), text.string_similarity(F.lit("porte des lilas"), F.col("t")), t="rue des lilas")
    assert better[0] == pytest.approx(1) and better[0] > better[1]
    assert one(spark, text.string_similarity(F.lit(""), F.col("t")), t="x") is None


def test_label_match(spark):
    match = lambda q, label: one(spark, text.label_match(F.col("q"), F.col("l")), q=q, l=label)
    assert [match("lilas", x) for x in ("lilas", "lilas rouges", "rue lilas", "rue")] == [1.0, 0.9, 0.7, 0.0]


def test_geohash(spark):
    hash_of = lambda lat, lon: one(spark, geo.geohash(F.col("a"), F.col("b")), a=lat, b=lon)
    assert hash_of(48.32545, 2.2565) == "u09dgm7" and hash_of(49.32545, 4.2565) == "u0g08g7"
    assert hash_of(90.0, 180.0) == "z" * 7 and hash_of(-90.0, -180.0) == "0" * 7
    cells = one(spark, geo.expand_geohash(F.col("a"), F.col("b")), a=48.32545, b=2.2565)
    assert len(set(cells)) == 9 and "u09dgm7" in cells
    assert len(set(one(spark, geo.expand_geohash(F.col("a"), F.col("b")), a=90.0, b=-180.0))) == 6


def test_distance(spark):
    km = one(spark, geo.haversine_km(F.lit(48.85), F.lit(2.35), F.col("a"), F.col("b")), a=45.76, b=4.84)
    assert km == pytest.approx(391.6, abs=1)
    assert one(spark, geo.km_to_score(F.lit(101.0)), geo.km_to_score(F.lit(0.0)), geo.km_to_score(F.col("k")), k=50.0) == pytest.approx((0.0, 1.0, 0.36787944))
