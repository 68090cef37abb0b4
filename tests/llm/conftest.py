import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _k string, size int"


def rows():
    """Texts of few words, so that much repeats: copies, near copies, shared passages and lines, and the odd cases."""
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)] + ["ä", "Öl,", "x|y", "#", "日本"]
    word = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line, base = word(60), " ".join(word(12)), word(120)
    texts = []
    for i in range(60):
        w = word(rng.randint(1, 150))
        if i % 6 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        if i % 9 == 0:
            w = list(base)
            for _ in range(i // 9):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        text = " ".join(w)
        if i % 5 == 0:
            text = f"{text}\n  {line.upper() if i % 10 else line}\t\n{rng.choice(vocabulary)}\n\n"
        texts.append(text)
    texts += [texts[3]] * 4 + [None, "", "", " \t\n", "one", "one two three", "one two three", "a b " * 300, " ".join(word(6000)), "x\x0by\x1cz\u00a0q"]
    out = [(i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", "S", None][i % 4]) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, texts[1], "en", "s1"), (None, None, None, None), (7 * 3, "another text under an id that is taken " * 3, "en", "s2")]
    return [(*r, len(r[1] or ""), "clash", "clash", 5) for r in out]


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame(raw, DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
