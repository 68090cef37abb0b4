"""The registered queries: against SQL where there is some, else against brute force, on whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_other_operators import brute_rule
from test_text_operators import brute_links, brute_targets, counts, same, words

from wayfind.llm import queries
from wayfind.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD_PAGES = [(10**6, None, None), (10**6 + 1, "no scheme", ""), (10**6 + 2, "http://x.net", "<p>short</p>"), (10**6 + 3, "https://EXAMPLE.net/en/1?q#f", "ä" * 70), (10**6 + 4, "https://a.example.com/a/b/c/d/e/f/g/h/1", "ä" * 70), (10**6 + 4, "https://a.example.com/a/b/c/d/e/f/g/h/1", "ä" * 70)]


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """A folder of odd documents, and of pages, some of them odd."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{at}/documents.parquet")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages.unionByName(spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_quality_rules(spark, odd, raw):
    out = queries.op4_quality_rules(spark, odd)
    expected = []
    for r in raw:
        n = counts(r[1])
        expected.append((r[0], *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    same([tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], expected)
    assert not out.where("kept is null or base_failed and kept").count()


def test_quality_estimates(spark):
    """Distances are those of the estimate's own fixed point: its h nearest documents give the estimate again."""
    import numpy as np

    from wayfind.llm import quality_rules
    from wayfind.llm.common import Scratch

    rng = np.random.default_rng(4)
    x = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 2]], 3000)
    x[:500] += [9, -9]
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "g string, a double, b double")
    out = quality_rules.robust_distances(df, {"a": 1e-3, "b": 1e-3}, ("g",), Scratch(spark, "test"))
    d = np.array([(r.a, r.b, r.distance2) for r in out.collect()])
    h = d[np.argsort(d[:, 2])[: math.ceil(0.75 * len(d))], :2]
    q = quality_rules.chi2_quantile(0.75, 2)
    cov = 0.75 / quality_rules.chi2_cdf(q, 4) * np.cov(h.T, bias=True)
    again = np.einsum("ij,jk,ik->i", d[:, :2] - h.mean(0), np.linalg.inv(cov), d[:, :2] - h.mean(0))
    assert np.corrcoef(again, d[:, 2])[0, 1] > 0.9999 and (np.abs(again - d[:, 2]) / (1 + d[:, 2])).max() < 0.1
    limit = quality_rules.chi2_quantile(0.999, 2)
    far = d[:, 2] > limit
    assert far.sum() >= 495 and (d[far][:, 0] > 5).sum() >= 490


def brute_mcd(x, floor, rng, share=0.75):
    """Squared distances from the best of many concentrated random starts, on exact subsets."""
    import numpy as np

    from wayfind.llm.quality_rules import chi2_cdf, chi2_quantile

    n, p = x.shape
    h, correction = math.ceil(share * n), share / chi2_cdf(chi2_quantile(share, p), p + 2)
    fit = lambda own: (own.mean(0), correction * np.cov(own.T, bias=True) + np.diag(floor) ** 2)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(40):
        m, c = fit(x[rng.choice(n, 3 * p, replace=False)])
        for _ in range(60):
            new = fit(x[np.argsort(far(m, c), kind="stable")[:h]])
            done = np.allclose(new[1], c) and np.allclose(new[0], m)
            m, c = new
            if done:
                break
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, far(m, c)
    return best[1]


def test_quality_verdicts_of_full_groups(spark, tmp_path):
    """The registered query on groups of language and source of their own estimates: its verdicts are those of a brute-force MCD, but for documents at the bar itself."""
    import random

    import numpy as np

    from wayfind.llm import quality_rules

    rng, rows = random.Random(11), []
    for g, (lang, source) in enumerate((("en", "a"), ("en", "b"), (None, "a"))):
        for i in range(260):
            w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6 + 2 * g))) for _ in range(rng.randint(40, 300))]
            lines = [" ".join(w[j : j + 12]) for j in range(0, len(w), 12)]
            if i % 13 == 0:
                lines = [x + "%" * rng.randint(1, 30) for x in lines]
            elif i % 13 == 1:
                lines += rng.choices(lines[:2], k=rng.randint(1, 30))
            rows.append((1000 * g + i, "\n".join(lines), lang, source, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op4_quality_rules(spark, str(tmp_path)).collect()}
    limit, floors = 1.5**2 * quality_rules.chi2_quantile(0.999999, 4), np.array([0.08, 0.06, 0.06, 0.06])
    checked = rejected = 0
    for g in range(3):
        own = [r for i, r in sorted(out.items()) if i // 1000 == g and not r.base_failed]
        lines = {i: sum(bool(x.split()) for x in t.split("\n")) for i, t, *_ in rows}
        x = np.array([[math.log((r.word_chars + 100) / (r.n_words + 20)), math.sqrt(r.n_symbols / (r.n_words + 20)), math.sqrt(r.n_dup_lines / (lines[r.doc_id] + 5)), math.sqrt(r.n_repeat_words / (r.n_words + 20))] for r in own])
        for r, d in zip(own, brute_mcd(x, floors, np.random.default_rng(g))):
            if abs(d - limit) > 0.15 * limit:
                checked += 1
                rejected += d > limit
                assert r.kept == (d <= limit), (r.doc_id, r.distance2, d)
    assert checked > 600 and rejected > 20


def test_ngram_join(spark, odd, raw):
    sets, links, _, classes = brute_links(raw)
    expected = [(r[0], classes[i], sum(bool(sets[i]) and sets[j] == sets[i] for j in links[i]), len(links[i])) for i, r in enumerate(raw)]
    same([tuple(r) for r in queries.op5_ngram_join(spark, odd).collect()], expected)


def test_ngram_join_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    sets, links, _, classes = brute_links(rows)
    expected = [(r[0], classes[i], len(links[i])) for i, r in enumerate(rows)]
    same([tuple(r) for r in queries.op5_ngram_join(spark, SMALL).select("doc_id", "class_id", "n_links").collect()], expected)
    assert any(x[2] for x in expected)


def test_packing(spark, odd, raw):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in raw:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            own = ids[p : p + 2048]
            expected.append((r[0], p // 2048, p, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    out = queries.op8_packing(spark, odd)
    same([tuple(r)[:5] for r in out.collect()], expected)


def test_mixing(spark, odd, raw):
    sizes = Counter()
    for r in raw:
        sizes[r[3]] += len(words(r[1]))
    aim, taken = brute_targets(sizes), Counter()
    by_id = {r[0]: r[3] for r in raw}
    for r in queries.op10_mixing(spark, odd).collect():
        assert r.taken <= 2 * r.size and any(abs(r.target - v) < 1e-6 * (1 + v) for v in aim.values())
        if r.doc_id is not None and r.doc_id != 21:
            assert r.source_size == sizes[by_id[r.doc_id]]
        taken[r.target] += r.taken
    for target, n in taken.items():
        assert abs(n - target) <= 0.001 * target + 2


def test_mixing_writes_files_by_its_input(spark, odd, tmp_path, monkeypatch):
    """However many shuffle partitions there are, the result and the written steps have as many files as the input needs; their rows stay the same."""
    from wayfind.llm.common import Scratch, file_count

    rows = lambda df: sorted(map(repr, df.collect()))
    want, files, keep = rows(queries.op10_mixing(spark, odd)), {}, Scratch.keep

    def counted(self, df, name, *a, **b):
        out = keep(self, df, name, *a, **b)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    most = file_count(queries.table(spark, odd, "documents"))
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        queries.op10_mixing(spark, odd).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out) == want
    assert most < 40 and len(out.inputFiles()) <= most and all(n <= most for n in files.values())
    assert all(files[x] <= -(-most // 3) for x in ("histogram", "named", "sources", "weights"))


def lexical(s):
    if len(s) > 40:
        return "{w}"
    if re.fullmatch(r"(?=.*\d)[0-9a-fA-F-]{8,}", s):
        return "{n}" if s.isdigit() else "{x}"
    return re.sub(r"[0-9]+", "{n}", s)


def brute_merges(branches, fanout, z):
    """{name: merged name} of one parent's branches {name: (labelled, bad)}."""
    out = {}
    if sum(not x.startswith("{") for x in branches) > fanout:
        out = {x: "{*}" for x in branches if not x.startswith("{")}
    rates = sorted(((b + 1) / (n + 2), x, n) for x, (n, b) in branches.items() if n and x not in out)
    groups = []
    for r, x, n in rates:
        var = r * (1 - r) / (n + 2)
        if groups and r - groups[-1][0][0] <= z * math.sqrt(var + groups[-1][0][2]):
            groups[-1].append((r, x, var))
        else:
            groups.append([(r, x, var)])
    for g in groups:
        if len(g) > 1:
            out |= {x: "{~" + min(y for _, y, _ in g) + "}" for _, x, _ in g}
    return out


def brute_tree(pages, depth=6, fanout=50, z=1.96, weight=5.0, reject=0.9):
    judged = [(i, *brute_rule(u)) for i, u in pages]
    key = lambda path: tuple([lexical(s) for s in path.split("/")][:depth]) + (("{*}",) if path.count("/") >= depth else ())
    urls = [(host, key(path), verdict) for _, host, path, _, verdict in judged]
    tpl = {(host, seg): list(seg) for host, seg, _ in urls}
    for level in range(1, depth):
        branches = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for host, seg, verdict in urls:
            t = tpl[host, seg]
            if len(t) > level:
                b = branches[host, tuple(t[:level])][t[level]]
                b[0] += verdict is not None
                b[1] += verdict == "block"
        merges = {at: brute_merges(b, fanout, z) for at, b in branches.items()}
        for (host, _), t in tpl.items():
            if len(t) > level:
                t[level] = merges[host, tuple(t[:level])].get(t[level], t[level])
    domain = lambda host: ".".join(host.split(".")[-2:])
    pools = defaultdict(lambda: [0, 0])
    for host, seg, verdict in urls:
        whole = (*seg, "$")
        for at in ["all", ("host", host, tuple(tpl[host, seg])), ("domain", domain(host), seg), *(("path", "/".join(whole[:i])) for i in range(2, len(whole) + 1))]:
            pools[at][0] += verdict is not None
            pools[at][1] += verdict == "block"
    out = []
    for (i, host, path, rule, verdict), (_, seg, _) in zip(judged, urls):
        whole, t = (*seg, "$"), tpl[host, seg]
        purity = pools["all"][1] / max(1, pools["all"][0])
        for at in [*(("path", "/".join(whole[:j])) for j in range(2, len(whole) + 1)), ("domain", domain(host), seg), ("host", host, tuple(t))]:
            n, bad = pools[at]
            purity = (bad + weight * purity) / (n + weight)
        out.append((i, host, path, rule, verdict or ("block" if purity >= reject else "allow"), "/".join(t), round(purity, 9)))
    return out


def test_url_filter_tells_urls_without_rule_apart(spark):
    """In the registered query, labels of other hosts reach urls that no rule decides: some are blocked, others are not."""
    out = queries.op2_url_filter(spark, "/root/testdata/sf0.01").where("rule is null")
    assert {r.verdict for r in out.select("verdict").distinct().collect()} == {"allow", "block"}
    assert out.selectExpr("round(purity, 6)").distinct().count() >= 5


def test_url_filter(spark, odd):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{odd}/pages.parquet").collect()]
    got = [(*tuple(r)[:6], round(r.purity, 9)) for r in queries.op2_url_filter(spark, odd).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()]
    same(got, brute_tree(pages))
