"""Line dedup, substring dedup, quality rules, mixing and packing against brute force on the small odd corpus."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfind.llm import line_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup
from wayfind.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def same(rows, expected):
    assert Counter(map(repr, rows)) == Counter(map(repr, expected))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_lines(docs, raw, none):
    keys = lambda t: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    at = defaultdict(set)
    for r in raw:
        for k in keys(r[1]):
            if len(k) >= 40:
                at[k].add(-(2**63) if r[0] is None else r[0])
    expected = []
    for r in raw:
        own = -(2**63) if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        left = [x for x, k in zip(lines, keys(r[1])) if len(k) < 40 or len(at[k]) < 5 or own == max(at[k])]
        expected.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    out = line_dedup.dedup_lines(docs)
    same([tuple(r) for r in out.select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()], expected)
    assert any(x[2] for x in expected)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(none).count() == 0


def brute_repeats(rows, window):
    seen = Counter()
    lists = [words(r[1]) for r in rows]
    for w in lists:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, lists):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substrings(docs, raw, none):
    for window in (35, 13):
        expected = brute_repeats(raw, window)
        out = substring_dedup.remove_repeats(docs, window=window)
        same([tuple(r) for r in out.collect()], expected)
        assert sum(x[2] for x in expected) > 500
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeated_spans_are_nonbranching_paths(spark):
    """Two passages that share their middle make five paths: the middle, and what leads to and from it; equal words have equal digests."""
    p = [f"p{i}" for i in range(200)]
    q = [f"q{i}" for i in range(60)] + p[60:140] + [f"q{i}" for i in range(140, 200)]
    rows = [(0, "a " + " ".join(p)), (1, "b " + " ".join(p)), (2, "c " + " ".join(q) + " c"), (3, " ".join(q)), (4, " ".join(p[100:130])), (5, "x " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(list)
    for r in substring_dedup.repeated_spans(df, window=20).collect():
        text = dict(rows)[r.doc_id].split()
        found[r.doc_id].append((r.start, r.n_words))
        assert r.n_words >= 20
    edges = lambda first, last: (first, last - first)  # noqa: E731  words from first up to last
    for doc, shift in ((0, 1), (1, 1), (2, 1), (3, 0)):
        assert sorted(found[doc]) == [edges(0 + shift, 79 + shift), edges(60 + shift, 140 + shift), edges(121 + shift, 200 + shift)]
    assert found[4] == [(0, 30)] and sum(n - 19 for _, n in found[5]) == 71  # one window, again and again
    same([tuple(r) for r in substring_dedup.remove_repeats(df, window=20).collect()], brute_repeats(rows, 20))


@pytest.mark.parametrize("window", [2, 7, 90])
def test_windows_of_other_sizes(spark, window):
    import random

    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(20)]
    long = [f"w{i}" for i in range(300)]
    texts += [" ".join(long), " ".join(["x", *long[:200], "y"]), " ".join(long[50:])]
    rows = list(enumerate(texts))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    same([tuple(r) for r in out.collect()], brute_repeats(rows, window))


def counts(text):
    w = words(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(again)


def test_quality_counts(docs, raw, none):
    out = quality_rules.judge(docs, least=20)
    expected = []
    for r in raw:
        n = counts(r[1])
        expected.append((r[0], *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same([tuple(r) for r in got], expected)
    assert not out.where("base_failed and kept").count()
    kept = quality_rules.good_documents(docs, least=20)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality_rules.judge(none).count() == 0


def test_quality_outliers(spark):
    """Documents full of symbols are rejected; in each group, plain ones stay, whatever part of the group is junk, below a quarter."""
    import random

    rng = random.Random(1)
    rows = []
    for i in range(1200):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 400))]
        if i % 7 == 0:
            w = [x + "%%$#"[: rng.randint(1, 4)] for x in w]
        rows.append((i, " ".join(w), ["en", "fr"][i % 2], "s"))
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] == (i % 7 != 0) for i in kept)


def plain_and_junk(rng, ids, lang, source):
    rows = []
    for n, i in enumerate(ids):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 400))]
        rows.append((i, " ".join(x + "%%$#" if n % 7 == 0 else x for x in w), lang, source))
    return rows, {i for n, i in enumerate(ids) if n % 7 == 0}


def test_quality_outliers_of_small_groups(spark):
    """A small source is judged by its language, a small language by the whole table, and a small table too."""
    import random

    rng = random.Random(2)
    parts = [plain_and_junk(rng, range(0, 600), "en", "s"), plain_and_junk(rng, range(600, 660), "en", "t"), plain_and_junk(rng, range(660, 810), None, "s"), plain_and_junk(rng, range(810, 811), "xx", None)]
    schema = "doc_id long, text string, lang string, source string"
    for some in (parts, parts[2:3]):
        rows, junk = [r for p, _ in some for r in p], set().union(*[j for _, j in some])
        out = quality_rules.judge(spark.createDataFrame(rows, schema)).collect()
        assert {r.doc_id for r in out} == {r[0] for r in rows} and all(r.distance2 is not None for r in out)
        assert {r.doc_id for r in out if not r.kept} == junk


def test_chi2():
    assert abs(quality_rules.chi2_cdf(9.487729, 4) - 0.95) < 1e-6
    assert abs(quality_rules.chi2_quantile(0.99, 3) - 11.344867) < 1e-5


def brute_links(raw, threshold=0.8):
    sets = []
    for r in raw:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(raw)
    near = lambda a, b: bool(a and b) and len(a & b) >= threshold * len(a | b)
    links = {i: [j for j in range(n) if j != i and near(sets[i], sets[j])] for i in range(n)}
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    key = lambda i: -(2**63) if raw[i][0] is None else raw[i][0]
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], 2**63), key(i))
    return sets, links, root, [least[root[i]] if least[root[i]] != -(2**63) else None for i in range(n)]


@pytest.mark.parametrize("block_rows", [1024, 2])
def test_near_duplicates(docs, raw, none, block_rows):
    sets, links, root, classes = brute_links(raw)
    out = ngram_join.near_duplicates(docs, block_rows=block_rows, recall=0.9999999)
    expected = [(r[0], classes[i], sum(bool(sets[i]) and sets[j] == sets[i] for j in links[i]), len(links[i])) for i, r in enumerate(raw)]
    same([tuple(r) for r in out.select("doc_id", "class_id", "n_copies", "n_links").collect()], expected)
    assert max(x[3] for x in expected) >= 4
    if block_rows == 1024:
        stay = ngram_join.one_of_each(docs, recall=0.9999999)
        assert stay.columns == docs.columns and stay.count() == len(set(root))
        assert ngram_join.near_duplicates(none).count() == 0


def test_near_duplicates_with_empty_blocks(spark):
    """A few long texts make more blocks than there are texts, so that some stay empty."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:200], f"x{i}", *base[200:]])) for i in range(3)] + [(3, "another text")]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=200)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out.collect()) == [(0, 0, 2), (1, 0, 2), (2, 0, 2), (3, 3, 0)]


@pytest.mark.parametrize("block_rows", [4, 20])
def test_near_duplicates_of_drifting_templates(spark, block_rows, monkeypatch):
    """A chain in which each text resembles only its neighbours is one group, compared bucket by bucket: far fewer pairs than the group has, all links found, each counted once."""
    stream = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(stream[3 * i : 3 * i + 60])) for i in range(100)] + [(200, " ".join(stream[30:90]))]
    sets, links, _, classes = brute_links(rows)
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows).collect()
    want = {r[0]: (classes[i], len(links[i])) for i, r in enumerate(rows)}
    assert {r.class_id for r in out} == {0} and sum(r.n_links for r in out) >= 0.998 * sum(n for _, n in want.values())
    assert all(r.n_links <= want[r.doc_id][1] for r in out)


def test_banding_recall(spark):
    """Of many pairs just above the threshold, in groups of their own, nearly all are found."""
    rows = []
    for i in range(1500):
        w = [f"{i}x{j}" for j in range(64)]
        rows += [(2 * i, " ".join(w[:58])), (2 * i + 1, " ".join(w[6:]))]  # 48 of 60 5-grams
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("n_links = 1").count() >= 2 * 1500 * 0.998


def test_banding():
    assert ngram_join.banding(0.8, 0.9995) == (20, 5) and ngram_join.banding(0.2, 0.9995)[0] > 24
    with pytest.raises(ValueError, match="no banding"):
        ngram_join.banding(0.05, 0.99999)
    for recall in (0.9, 0.999, 0.99999):
        bands, rows = ngram_join.banding(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall


def test_components(spark):
    from wayfind.llm.common import Scratch
    from wayfind.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)] + [(200, 201 + i) for i in range(30)]
    out = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    assert {r.v: r.root for r in out.collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, **{201 + i: 200 for i in range(30)}}


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        aim = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: 2.0 * sizes[s] for s in capped}
        over = [s for s in free if aim[s] > 2 * sizes[s]]
        if not over:
            return aim
        capped.update(over)


def test_mixing(docs, raw, none):
    sizes = Counter()
    for r in raw:
        sizes[r[3]] += len(words(r[1]))
    aim = brute_targets(sizes)
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], len(words(r[1]))) for r in raw)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - aim[r.source]) < 1e-6 * (1 + aim[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= 0.001 * aim[s] + 2, (s, taken[s], aim[s])
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(none).count() == 0


def test_mixing_rates_are_those_of_entropy_balancing(spark):
    """Every size's copies are within one rounding of its documents' exact rates, found here by bisection over all documents."""
    import math
    import random

    rng = random.Random(8)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 9 % 700), "ab"[i % 3 == 0]) for i in range(900)]
    rows += [(None, "w " * 33, "a")] * 40 + [(5000 + i, "", None) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=3).collect()
    assert len(out) == len(rows)
    for source, aim in brute_targets({s: sum(len(t) // 2 for _, t, x in rows if x == s) for s in ("a", "b", None)}).items():
        sizes = [len(t) // 2 for _, t, x in rows if x == source]
        mean = sum(sizes) / len(sizes) or 1
        rate = lambda v, n: min(2.0, math.exp(min(50, v * n / mean)))
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * rate(mid, n) for n in sizes) < aim else (low, mid)
        counts, taken = Counter(sizes), Counter()
        for r in out:
            if r.source == source:
                assert 0 <= r.copies <= 2
                taken[r.size] += r.copies
        if source is not None:
            owed = 0.0
            for n in sorted(counts, reverse=True):
                owed += n * (counts[n] * rate(low, n) - taken[n])
                assert abs(owed) <= max(0.51 * n, 0.001 * aim) or taken[n] == 2 * counts[n], (source, n, owed)
            assert abs(sum(n * c for n, c in taken.items()) - aim) <= 1 + 1e-6 * aim or min(counts) > 1


def test_mixing_of_many_sources(spark):
    """Thousands of sources: weights in turn by code point, shares resharing over several rounds."""
    rows = [(i, "w " * (1 + i * i % 97), f"s{i * 7919 % 3001:05d}") for i in range(6000)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t) // 2
    aim = brute_targets(sizes)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(r.target - aim[r.source]) < 1e-6 * (1 + r.target) for r in out)


def test_mixing_targets_stop_at_twice_the_size(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a")] * 3 + [(200, "b")] * 9 + [(90, "c")] * 4 + [(0, "d")])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    aim = brute_targets({"a": 30, "b": 1800, "c": 360, "d": 0})
    assert all(abs(r.target - aim[r.source]) < 1e-6 for r in out)
    assert {r.copies for r in out if r.source == "a"} == {2}


def test_packing(docs, raw, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in raw:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            own = ids[p : p + 2048]
            expected.append((r[0], p // 2048, p, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    out = packing.pack_documents(docs, tokenizer_path()).collect()
    same([tuple(r)[:5] for r in out], expected)
    placed = defaultdict(list)
    for r in out:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(placed) <= -(-sum(x[3] for x in expected) // 2048) + 1
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def ids_of(tokenizer, texts):
    tokens, offsets = tokenizer.ids([t.encode() for t in texts], 7)
    ids = [tokens[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert len(ids) == len(texts) and all(x[-1] == 7 for x in ids)
    return [x[:-1] for x in ids]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "changed"])
def test_other_tokenizers_encode_whole_texts(name, tmp_path):
    """A tokenizer of another shape, such as one that keeps capitals, is told apart by its file."""
    import json

    from tokenizers import Tokenizer

    path = tokenizer_path(name) if name != "changed" else str(tmp_path / "t.json")
    if name == "changed":
        with open(tokenizer_path()) as f:
            spec = json.load(f)
        spec["normalizer"]["normalizers"].pop()
        (tmp_path / "t.json").write_text(json.dumps(spec))
    own = packing.WordTokenizer(path)
    texts = ["It's  FINE,\n don't", "", "a1 b22  c", "Ünï"]
    assert not own.by_words and packing.WordTokenizer(tokenizer_path()).by_words
    assert ids_of(own, texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    texts = ["It's <|endoftext|>fine\u00a0e\u0301 İstanbul ΑΣ, don't\x1cstop", "\u0301 x \u0301y", "naïve 12,5 ½ … — 日本語テキスト 👍🏽", "a\x85b\u2028c <|startoftext|>"]
    tok = Tokenizer.from_file(tokenizer_path())
    assert ids_of(packing.WordTokenizer(tokenizer_path()), texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_fullest_is_the_best_sum():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 80)
        items = [x for x, c in counts.items() for _ in range(c)]
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        got = packing.fullest(counts, room)
        assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


def test_pieces_keep_ids(docs):
    out = packing.pack_documents(docs, tokenizer_path(), capacity=64, keep_ids=True)
    r = out.where("length = 64").first()
    assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 256


def test_kept_hash_is_that_of_utf8(docs):
    r = substring_dedup.remove_repeats(docs).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.kept.encode()).hexdigest()


def test_word_tokenizer_on_random_strings():
    import random

    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), most=300)
    letters = [*"abcXYZéÉßñ×÷…—. ,.\n\t'sTm!?<|> ́ǅʰ日0123½İΣςक़", "'s ", "'LL ", " . ", "<|endoftext|>", "<|ENDOFTEXT|>", "&#", "(x", "ab'", "é.", "é'd ", "×.", "ª,", "\x1c", "\u0301", "12"]
    rng = random.Random(1)
    for _ in range(1500):
        texts = ["".join(rng.choice(letters[: rng.choice([6, 12, 20, len(letters)])]) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        assert ids_of(words, texts) == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_null_ids_with_equal_32_bit_hashes(spark):
    """Two texts under null ids whose 32-bit hashes, as Spark's hash() gives them, are equal stay two documents in every operator."""
    line, passage = "one line of over forty code points that seven documents share", " ".join(f"w{i}" for i in range(60))
    first, second = "text 0046562", "text 0083333"
    texts = [(None, f"{first}\n{line}\nx {passage}"), (None, f"{second}\n{line}\nx {passage}"), *[(i, f"{i} is its own\n{line}\n{i} {passage}") for i in range(6)]]
    df = spark.createDataFrame([(*t, "en", "s") for t in texts], "doc_id long, text string, lang string, source string").coalesce(1)
    assert df.where("doc_id is null").select(F.hash("text")).distinct().count() == 1
    same([r.kept for r in line_dedup.dedup_lines(df).collect()], [t if i == 5 else t.replace(f"{line}\n", "") for i, t in texts])
    same([tuple(r) for r in substring_dedup.remove_repeats(df).collect()], brute_repeats(texts, 35))
    same([r.text for r in quality_rules.good_documents(df).collect()], [t for _, t in texts])
    copies = mixing.mix(df).collect()
    assert sorted(r.doc_id is None for r in copies) == [False] * 6 + [True] * 2
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in copies)
    found = ngram_join.near_duplicates(df, threshold=0.99).collect()
    assert len({(r._k, bytes(r._t)) for r in found}) == len(found) == 8
    same([r.text for r in ngram_join.one_of_each(df, threshold=0.99).collect()], [t for _, t in texts])
