"""Quality rules: counts of every whole text, a base rule, and robust multivariate outliers per language and source.

Location and scatter are minimum-covariance-determinant estimates, found deterministically: from three starts
by concentration steps, each of which re-estimates from the h documents nearest to the last estimate, until they stand still; the
estimate of the least determinant counts. All documents take part.
What a step gathers are sums of powers and a histogram of distances per group, both combined before they move, so that a
group of any size costs its tasks no more than their own rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch, row_key, slices, tidy, uncarried

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RUN = 5


def _repeats(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in RUN-word windows found twice or more in it. Exact: windows are compared by ids built from ids of pairs."""
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for x in words for w in x), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.zeros(len(words), np.int64)
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    two = dense(ids[:-1] * (len(known) + 1) + ids[1:])
    four = dense(two[:-2] * (int(two.max()) + 1) + two[2:])[:n]
    five = dense(four * (len(known) + 1) + ids[RUN - 1 :])
    inside = doc[:n] == doc[RUN - 1 :]
    at = np.flatnonzero(inside)
    _, back, times = np.unique(doc[at] * (int(five.max()) + 1) + five[at], return_inverse=True, return_counts=True)
    starts = at[times[back] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + RUN] -= 1  # starts are distinct
    return np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=len(words)).astype(np.int64)


def count_texts(docs: DataFrame) -> DataFrame:
    """Every row of docs with the COUNTS of its whole text (null: empty)."""
    extra = ", ".join(f"{c} long" for c in COUNTS)

    def count(batches):
        for part, texts in slices(batches, "text"):
            words = [x.split() for x in texts]
            rows = []
            for text, own in zip(texts, words):
                lines = text.split(b"\n")
                held = [x for x in lines if x.strip()]
                joined = b"".join(own)
                rows.append((len(own), len(joined.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(held) - len(set(held)), len(held)))
            n, chars, symbols, dups, lines = (np.array(x, dtype=np.int64) for x in zip(*rows))
            names = [x for x in part.schema.names if x != "text"]
            arrays = [part.column(part.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, (n, chars, symbols, dups, _repeats(words), lines))], [*names, *COUNTS])

    kept = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"]
    return docs.mapInArrow(tidy(count), ", ".join(kept) + ", " + extra)


def features() -> dict[str, tuple[Column, float]]:
    """The transformed statistics and their noise floors. Counts are smoothed by 20 words, so that short texts don't stand out by chance; square roots steady the variance of rates."""
    n = F.col("n_words") + F.lit(20.0)
    return {
        "f_length": (F.log((F.col("word_chars") + F.lit(100.0)) / n), 0.08),
        "f_symbols": (F.sqrt(F.col("n_symbols") / n), 0.06),
        "f_lines": (F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(5.0))), 0.06),
        "f_repeats": (F.sqrt(F.col("n_repeat_words") / n), 0.06),
    }


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-16 * total and n < 10_000:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, p) < q and high < 600:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def _group(rows: DataFrame, by: tuple[str, ...], least: int, scratch: Scratch) -> DataFrame:
    """_g and _in of each combination of by. _g: what its rows are judged by, the combination itself if it has `least` rows, else all rows that share
    its first columns, as many of them as give `least` rows, else all rows of the table. _in: every group in use whose estimate its rows take part in."""
    sizes = scratch.keep(rows.groupBy(*by).agg(F.count("*").alias("_n")), "sizes", few=4)
    levels = [by[:i] for i in range(len(by), 0, -1)]
    name = lambda keys: F.to_json(F.array(*[F.col(c).cast("string") for c in keys])) if keys else F.lit("[]")

    def with_(df: DataFrame, other: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        other = other.withColumnsRenamed({c: f"_at_{c}" for c in keys})
        return df.join(other, [df[c].eqNullSafe(other[f"_at_{c}"]) for c in keys], "left").drop(*[f"_at_{c}" for c in keys])

    out = sizes
    for keys in levels:
        out = with_(out, sizes.groupBy(*keys).agg(F.sum("_n").alias(f"_n{len(keys)}")), keys)
    out = out.withColumn("_g", F.coalesce(*[F.when(F.col(f"_n{len(keys)}") >= least, name(keys)) for keys in levels], name(())))
    out = scratch.keep(out, "judged", few=4)
    rest = out.where(F.col("_g") == name(())).limit(1).count()
    used = [F.lit("[]") if rest else F.lit(None).cast("string")]
    for keys in levels:
        out = with_(out, out.where(F.col("_g") == name(keys)).select(*keys).distinct().withColumn(f"_u{len(keys)}", F.lit(True)), keys)
        used.append(F.when(F.col(f"_u{len(keys)}"), name(keys)))
    return out.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_g", F.array_compact(F.array(*used)).alias("_in"))


def robust_distances(rows: DataFrame, columns: dict[str, float], by: tuple[str, ...], scratch: Scratch, share: float = 0.75, steps: int = 12, least: int = 200, tolerance: float = 0.005) -> DataFrame:
    """rows with distance2: the squared Mahalanobis distance from the MCD estimate of their group, or of a wider one where it has under `least` rows.

    columns: names with noise floors, whose squares are added to the variances: a statistic that is nearly always the
    same would else make every deviation an outlier. share: h as a part of the group. Three starts (medians and MADs, medians and
    the scatter of directions from them, means and covariances) concentrate step by step, side by side, until no
    logarithm of a determinant moves by more than the tolerance, or for `steps` steps; each group keeps the estimate of the least determinant.
    """
    names, p = list(columns), len(columns)
    groups = _group(rows, by, least, scratch)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    rows = scratch.keep(rows.join(groups, same).select(*rows.columns, "_g", "_in"), "grouped")
    once = rows.select(F.explode("_in").alias("_g"), *names)
    fit = once.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    floor = np.diag([columns[c] ** 2 for c in names])
    q = chi2_quantile(share, p)
    correction = share / chi2_cdf(q, p + 2)
    cells = [(i, j) for i in range(p) for j in range(i, p)]

    @F.pandas_udf("array<double>")
    def inverse(sums: pd.Series, n: pd.Series) -> pd.Series:
        """Means, inverse covariances and the logarithm of their determinant, from sums of values and products."""
        out = []
        for s, k in zip(sums, n):
            s = np.asarray(s, dtype=float) / k
            mean, second = s[:p], np.zeros((p, p))
            second[np.triu_indices(p)] = s[p:]
            second = np.triu(second) + np.triu(second, 1).T
            cov = correction * (second - np.outer(mean, mean)) + floor
            out.append(np.concatenate([mean, np.linalg.inv(cov).ravel(), [np.linalg.slogdet(cov)[1]]]))
        return pd.Series(out)

    def distance(est: Column) -> Column:
        d = [F.col(c) - est[i] for i, c in enumerate(names)]
        terms = [d[i] * d[j] * est[p + i * p + j] * (1 if i == j else 2) for i, j in cells]
        return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))

    products = lambda x: [x[i] * x[j] for i, j in cells]
    # medians and MADs, then the sums of the three starts
    med = once.groupBy("_g").agg(*[F.percentile_approx(c, 0.5).alias(f"m{i}") for i, c in enumerate(names)], F.count("*").alias("_n"))
    med = scratch.keep(med, "medians", few=2)
    off = once.join(med, "_g").select("*", *[(F.col(c) - F.col(f"m{i}")).alias(f"o{i}") for i, c in enumerate(names)])
    mad = off.groupBy("_g").agg(*[F.percentile_approx(F.abs(f"o{i}"), 0.5).alias(f"s{i}") for i in range(p)])
    mad = scratch.keep(mad.select("_g", *[F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + F.lit(float(floor[i, i]))).alias(f"s{i}") for i in range(p)]), "mads", few=2)
    z = [F.col(f"o{i}") / F.col(f"s{i}") for i in range(p)]
    size = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    u = [x / size for x in z]
    sums = off.join(mad, "_g").groupBy("_g").agg(
        F.first("_n").alias("_n"), *[F.first(f"{x}{i}").alias(f"{x}{i}") for x in "ms" for i in range(p)],
        F.array(*[F.sum(x) for x in products(u)]).alias("u"), F.array(*[F.sum(c) for c in names], *[F.sum(x) for x in products([F.col(c) for c in names])]).alias("c"),
    )
    m, sd, n = [F.col(f"m{i}") for i in range(p)], [F.col(f"s{i}") for i in range(p)], F.col("_n")
    plain = F.array(*[n * x for x in m], *[n * (m[i] * m[j] + (sd[i] * sd[i] if i == j else F.lit(0.0))) for i, j in cells])
    ways = F.array(*[n * x for x in m], *[n * m[i] * m[j] + p * F.col("u")[k] * sd[i] * sd[j] for k, (i, j) in enumerate(cells)])
    now = sums.select("_g", "_n", F.posexplode(F.array(plain, ways, F.col("c"))).alias("_s", "sums")).select("_g", "_n", "_s", inverse("sums", "_n").alias("est"))
    now = scratch.keep(now, "start", few=2)
    for step in range(steps):
        # distances fall into 32 bins an octave: the h-th is known up to two hundredths of itself
        bin_ = F.floor(32 * F.log2(distance(F.col("est")) + F.lit(1e-6)))
        bins = fit.join(now, ["_g", "_s"]).withColumn("_bin", bin_).groupBy("_g", "_s", "_bin").agg(F.count("*").alias("k"), F.first("_n").alias("_n"))
        below = F.sum("k").over(Window.partitionBy("_g", "_s").orderBy("_bin")) - F.col("k")
        cut = bins.withColumn("_b", below).where(F.col("_b") < F.ceil(share * F.col("_n"))).groupBy("_g", "_s").agg(F.max("_bin").alias("_cut"))
        cut = scratch.keep(cut.join(now, ["_g", "_s"]), f"cut{step}", few=2)
        inside = fit.join(cut, ["_g", "_s"]).where(bin_ <= F.col("_cut"))
        moments = inside.groupBy("_g", "_s").agg(F.array(*[F.sum(c) for c in names], *[F.sum(x) for x in products([F.col(c) for c in names])]).alias("s"), F.count("*").alias("k"), F.first("_n").alias("_n"), F.first("est").getItem(p + p * p).alias("was"))
        now = scratch.keep(moments.select("_g", "_n", "_s", inverse("s", "k").alias("est"), "was"), f"step{step}", few=2)
        moved = now.where(F.abs(F.col("est")[p + p * p] - F.col("was")) > tolerance).limit(1).count()
        now = now.drop("was")
        if not moved:
            break
    best = now.groupBy("_g").agg(F.min_by("est", F.col("est")[p + p * p]).alias("est"))
    return rows.join(best, "_g").withColumn("distance2", distance(F.col("est"))).drop("_g", "_in", "est")


def judge(docs: DataFrame, keep_share: float = 0.999999, extra: float = 1.5, min_words: int = 10, max_repeat_percent: int = 20, least: int = 200) -> DataFrame:
    """doc_id, lang, source, _k, _t, COUNTS, base_failed, distance2 and kept of every row.

    base_failed: under min_words words, or over max_repeat_percent % of them in repeated windows. Of the others, those
    are rejected whose squared distance is over `extra` squared times the chi-square quantile of keep_share: the quantile
    is that of normal statistics, but those of texts have heavier tails, and without `extra` documents of another style would go
    along with the junk. The estimates come from all that pass the base rule. Groups of under `least` rows are judged by the
    estimate over all rows of their language, and those of languages of under `least` rows by that over all rows. Null texts are empty, null
    languages and sources group like others; rows that repeat count each; an empty table gives no rows; other columns are
    ignored. _k and _t name a row by its id and a digest of its text, language and source.
    """
    scratch = Scratch(docs.sparkSession, "quality", docs)
    counted = count_texts(docs.select("doc_id", "lang", "source", *row_key("text", "doc_id", "lang", "source"), "text"))
    n, r = F.col("n_words"), F.col("n_repeat_words")
    counted = scratch.keep(counted.withColumn("base_failed", (n < min_words) | (100 * r > max_repeat_percent * n)), "counts")
    spec = features()
    passed = counted.where("not base_failed").select("*", *[c.alias(name) for name, (c, _) in spec.items()])
    far = robust_distances(passed, {name: f for name, (_, f) in spec.items()}, ("lang", "source"), scratch, least=least).drop(*spec)
    limit = extra**2 * chi2_quantile(keep_share, len(spec))
    far = far.withColumn("kept", F.col("distance2") <= limit)
    failed = counted.where("base_failed").withColumns({"distance2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return far.unionByName(failed)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, whole and in any number; nulls, ties, repeated rows and empty tables as in judge()."""
    scratch = Scratch(docs.sparkSession, "good", docs)
    gone = scratch.keep(judge(docs, **options).where("not kept").select("_k", "_t").distinct(), "rejected")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *row_key("text", "doc_id", "lang", "source")).join(gone, ["_k", "_t"], "left_anti")
    return rows.select(*uncarried(rows, docs))
