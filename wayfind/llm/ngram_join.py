"""N-gram Jaccard join by MinHash banding: all links between documents whose word n-gram sets have at least a given Jaccard similarity.

1. Each text gives its n-gram set (64-bit hashes), a 128-bit digest of it and `bands` band hashes, which alone move on.
   Rows, the number of hashes in a band, and bands are chosen so that a pair at the threshold shares a band with
   probability `recall`.
2. Documents of equal sets are one class; only classes meet from here on.
3. Classes are shuffled on band hashes. Each bucket of two or more gives a star of candidate edges, whose connected
   components are the candidate groups. Most documents are in none and go no further.
4. A group that fits one task is compared whole. A larger one whose buckets hold fewer pairs than the group itself, as where templates
   drift and each class resembles but its neighbours, is compared bucket by bucket; a pair counts in the first band that
   it shares. What is compared is cut into blocks of bounded rows and bytes; pairs of blocks meet in tasks of their own,
   which compare full n-gram sets by products of incidence matrices. A task returns one row per class: its number of
   links and its local root, never the pairs.
5. Components of the true links, found the same way, are the near-duplicate groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import Rolling, Scratch, WordHash, carried, hashed_words, mix, row_key, slices, tidy, uncarried
from wayfind.llm.components import components

BASE = 0x2545F4914F6CDD1D


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of the choices within `most` hashes that reach the recall at the threshold, the one with the fewest chance candidates at half of it. ValueError if there is none."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            chance = 1 - (1 - (threshold / 2) ** rows) ** bands
            best = min(best or (2, 0, 0), (chance, bands, rows))
    if best is None:
        raise ValueError(f"no banding of {most} hashes finds pairs of similarity {threshold} with probability {recall}")
    return best[1], best[2]


def _sets(texts: list[bytes], n: int, cache: WordHash, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of all texts, repeats included, and where each text's start. A text of fewer words is one n-gram; one without words has none."""
    words, offsets = hashed_words(texts, cache)
    sizes = np.diff(offsets)
    grams = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    out = np.zeros(len(grams) + 1, dtype=np.int64)
    np.cumsum(grams, out=out[1:])
    doc = np.repeat(np.arange(len(grams)), grams)
    start = offsets[doc] + np.arange(len(doc)) - out[doc]
    return roll.of(roll.sums(words), start, np.minimum(start + n, offsets[doc + 1])), out


def sketch(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """_k, _t, c (128-bit digest of the n-gram set; null without words), grams, bytes, bands (array of hashes) of every row."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches):
        cache, roll = WordHash(), Rolling(BASE)
        for part, texts in slices(batches, "text"):
            h, offsets = _sets(texts, n, cache, roll)
            held = np.flatnonzero(np.diff(offsets))
            starts = offsets[:-1][held]
            digests: list[bytes | None] = [None] * len(texts)
            sizes = np.zeros(len(texts), dtype=np.int64)
            for i in held:
                own = np.unique(h[offsets[i] : offsets[i + 1]])
                sizes[i] = len(own)
                digests[i] = np.array([own.sum(), mix(own ^ np.uint64(BASE)).sum()], dtype=np.uint64).tobytes()
            marks = np.zeros((len(held), bands), dtype=np.uint64)
            if len(held):
                for b in range(bands):
                    for r in range(rows):
                        j = b * rows + r
                        low = np.minimum.reduceat((h ^ flips[j]) * factors[j], starts)
                        marks[:, b] = mix(marks[:, b] * np.uint64(BASE) + low + np.uint64(b + 1))
            flat = pa.array(marks.view(np.int64).ravel())
            places = np.zeros(len(texts) + 1, dtype=np.int32)
            places[1:][held] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(places), pa.int32()), flat)
            size = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes), size, lists], ["_k", "_t", "c", "grams", "bytes", "bands"])

    return docs.select(*row_key(), "text").mapInArrow(tidy(run), "_k long, _t binary, c binary, grams long, bytes long, bands array<long>")


class Block:
    """Classes with their n-gram sets and band hashes."""

    def __init__(self, c: list[bytes], copies: np.ndarray, sizes: np.ndarray, grams: np.ndarray, marks: np.ndarray):
        self.c, self.copies, self.sizes, self.grams, self.marks = c, copies, sizes, grams, marks

    @classmethod
    def of_texts(cls, c: list[bytes], copies: list[int], texts: list[bytes], marks: list, n: int) -> Block:
        first: dict[bytes, int] = {}
        for i, x in enumerate(c):  # rows that repeat
            first.setdefault(x, i)
        at = list(first.values())
        cache, roll, sets = WordHash(), Rolling(BASE), []
        for lo in range(0, len(at), 64):
            h, offsets = _sets([texts[i] for i in at[lo : lo + 64]], n, cache, roll)
            sets += [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return cls(list(first), np.array([copies[i] for i in at], np.int64), np.array([len(x) for x in sets], np.int64), np.concatenate([*sets, np.empty(0, np.uint64)]), np.array([marks[i] for i in at], np.int64))


def linked(a: Block, b: Block | None, threshold: float, columns: int = 2048) -> np.ndarray:
    """Which classes of a and b (or of a and itself) have at least the similarity, as a matrix of booleans."""
    own = b is None
    b = a if own else b
    na, nb = len(a.c), len(b.c)
    grams = a.grams if own else np.concatenate([a.grams, b.grams])
    row = np.repeat(np.arange(na), a.sizes)
    if not own:
        row = np.concatenate([row, na + np.repeat(np.arange(nb), b.sizes)])
    _, col, times = np.unique(grams, return_inverse=True, return_counts=True)
    used = times[col] > 1  # an n-gram of one class is in no intersection
    row, col = row[used], np.unique(col[used], return_inverse=True)[1] if used.any() else col[used]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((na, nb), dtype=np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, columns):
        s, e = np.searchsorted(col, [lo, lo + columns])
        x = np.zeros((na if own else na + nb, min(columns, width - lo)), dtype=np.float32)
        x[row[s:e], col[s:e] - lo] = 1
        common += x[:na] @ (x if own else x[na:]).T
    need = (a.sizes[:, None] + b.sizes[None, :]) * (threshold / (1 + threshold))
    out = common >= need - 1e-6
    if own:
        np.fill_diagonal(out, False)
    return out


def _roots(match: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a match matrix, the least place (columns after rows) in the component of each."""
    na, nb = match.shape
    if own:
        label = np.arange(na)
        while True:
            new = np.minimum(label, np.where(match, label[None, :], na).min(axis=1))
            new = new[new]
            if (new == label).all():
                return label, label
            label = new
    la, lb = np.arange(na), np.arange(na, na + nb)
    while True:
        nl = np.minimum(la, np.where(match, lb[None, :], na + nb).min(axis=1))
        nr = np.minimum(lb, np.where(match, nl[:, None], na + nb).min(axis=0))
        if (nl == la).all() and (nr == lb).all():
            return la, lb
        la, lb = nl, nr


LINKS = "c binary, links long, root binary"


def _rows(a: Block, b: Block | None, threshold: float, bucket: int | None = None) -> pa.Table:
    """bucket: the band hash that all classes share; pairs that share an earlier band are left to its bucket."""
    match = linked(a, b, threshold)
    if bucket is not None:
        i, j = np.nonzero(match)
        for lo in range(0, len(i), 100_000):
            x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
            left, right = a.marks[x], (a if b is None else b).marks[y]
            first = (left == right).argmax(axis=1)
            match[x, y] = left[np.arange(len(x)), first] == bucket
    la, lb = _roots(match, b is None)
    names = a.c + ([] if b is None else b.c)
    got = [(a.c, match @ (a if b is None else b).copies, la)] + ([] if b is None else [(b.c, a.copies @ match, lb)])
    c, links, root = [], [], []
    for own, n, label in got:
        for i in np.flatnonzero(n):
            c.append(own[i])
            links.append(int(n[i]))
            root.append(names[label[i]])
    return pa.table({"c": pa.array(c, pa.binary()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.binary())})


PACKED = "group binary, block long, blocks long, bucket long, c array<binary>, copies array<long>, sizes array<long>, grams binary, marks binary"


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block_rows: int = 1024, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, _k, _t, class_id, n_copies, n_links, root of every row of docs.

    class_id: the least id in its group of documents joined by links, through any number of them. n_links: the number
    of other rows whose n-gram sets have at least the similarity, n_copies of them with an equal set. root: the group's
    least digest, which names it even where ids repeat. Words are runs
    without ASCII white space, as they are; a text of fewer than n words is one n-gram. Texts without words, and nulls,
    are like no other and stay alone (class_id is their own id). A null id counts as smaller than all others and gives a
    null class_id. Rows that repeat are copies. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngrams", docs)
    bands, rows = banding(threshold, recall)
    marks = scratch.keep(sketch(docs, n, bands, rows), "sketch")
    one = F.min(F.struct("_k", "_t", "bytes", "bands"))
    classes = marks.where("c is not null").groupBy("c").agg(F.count("*").alias("copies"), one.alias("one"))
    classes = scratch.keep(classes.select("c", "copies", "one._k", "one._t", "one.bytes", "one.bands"), "classes")
    spread = classes.select("c", F.explode("bands").alias("b"))
    buckets = spread.groupBy("b").agg(F.min("c").alias("m"), F.count("*").alias("size")).where("size > 1")
    candidates = spread.join(buckets, "b").where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v"))
    groups = components(candidates, scratch, "candidates")
    groups = scratch.keep(groups.select(F.col("v").alias("c"), F.col("root").alias("group")).unionByName(groups.select(F.col("root").alias("c"), F.col("root").alias("group")).distinct()), "groups")
    held = scratch.keep(groups.join(classes.select("c", "copies", "_k", "_t", "bytes", "bands"), "c"), "held")
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block_rows), F.ceil(size / block_bytes)).cast("long")
    sizes = scratch.keep(held.groupBy("group").agg(F.count("*").alias("n"), parts(F.count("*"), F.sum("bytes")).alias("blocks")), "sizes")
    big = held.join(sizes.where("blocks > 1"), "group").select("group", "c", "bytes", "n", F.explode("bands").alias("bucket"))
    shared = big.groupBy("group", "bucket").agg(F.count("*").alias("k"), F.sum("bytes").alias("size"), F.first("n").alias("n")).where("k > 1")
    shared = scratch.keep(shared, "buckets")
    drift = scratch.keep(shared.groupBy("group").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("pairs"), F.first("n").alias("n")).where("pairs < double(n) * n").select("group"), "drift")
    own = ("c", "copies", "_k", "_t", "bands")
    whole = held.join(sizes, "group").join(drift, "group", "left_anti").select("group", F.lit(None).cast("long").alias("bucket"), "blocks", *own)
    banded = held.join(drift, "group").withColumn("bucket", F.explode("bands")).join(shared.select("group", "bucket", parts(F.col("k"), F.col("size")).alias("blocks")), ["group", "bucket"])
    named = F.encode(F.concat(F.hex("group"), F.lit(":"), F.col("bucket").cast("string")), "UTF-8")
    texts = whole.unionByName(banded.select(named.alias("group"), "bucket", "blocks", *own)).withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    texts = docs.select(*row_key(), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).join(texts, ["_k", "_t"])

    def block_of(t):
        return Block.of_texts(*(t.column(x).to_pylist() for x in ("c", "copies", "text", "bands")), n)

    def alone(key, t):
        return _rows(block_of(t), None, threshold, t.column("bucket")[0].as_py())

    def packed(key, t):
        x = block_of(t)
        one = {"group": key[0], "block": key[1], "blocks": t.column("blocks")[0], "bucket": t.column("bucket")[0]}
        lists = {"c": pa.array([x.c], pa.list_(pa.binary())), "copies": pa.array([x.copies.tolist()], pa.list_(pa.int64())), "sizes": pa.array([x.sizes.tolist()], pa.list_(pa.int64()))}
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in one.items()}, **lists, "grams": pa.array([x.grams.tobytes()], pa.binary()), "marks": pa.array([x.marks.tobytes()], pa.binary())})

    def meet(key, left, right):
        if not left.num_rows or not right.num_rows:  # no class fell into one of the blocks
            return pa.table({"c": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        at = [r.to_pylist()[0] for r in (left, right)]
        a, b = (Block(r["c"], np.array(r["copies"], np.int64), np.array(r["sizes"], np.int64), np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["marks"], np.int64).reshape(len(r["c"]), -1)) for r in at)
        return _rows(a, None if key[1].as_py() == key[2].as_py() else b, threshold, at[0]["bucket"])

    texts = scratch.keep(texts, "texts")
    small = scratch.keep(texts.where("blocks = 1 and bucket is null").groupBy("group").applyInArrow(alone, LINKS), "small")
    spread = scratch.keep(texts.where("blocks = 1 and bucket is not null").groupBy("group").applyInArrow(alone, LINKS), "spread")
    blocks = scratch.keep(texts.where("blocks > 1").groupBy("group", "block").applyInArrow(packed, PACKED), "blocks")
    scratch.drop("texts")
    left = blocks.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = blocks.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "block")))
    large = scratch.keep(left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInArrow(meet, LINKS), "large")
    scratch.drop("blocks")
    large = large.unionByName(spread)  # a class is in many blocks or buckets here, and in one small group
    roots = components(large.select(F.col("c").alias("u"), F.col("root").alias("v")), scratch, "links").select(F.col("v").alias("c"), "root")
    roots = roots.unionByName(small.where("c <> root").select("c", "root"))
    links = small.unionByName(large).groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "copies", "_k").join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    known = scratch.keep(known, "known")
    least = known.groupBy("root").agg(F.min("_k").alias("class"))
    named = known.join(least, "root").select("c", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "class", "root")
    out = marks.select("_k", "_t", "c").join(named, "c", "left")
    null_id = lambda c: F.when(c != -(2**63), c)
    copies = F.coalesce(F.col("copies") - 1, F.lit(0).cast("long"))
    return out.select(
        null_id(F.col("_k")).alias("doc_id"), "_k", "_t", null_id(F.coalesce("class", "_k")).alias("class_id"),
        copies.alias("n_copies"), (copies + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), "root",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but for near duplicates, of which the row with the least id (then digest of text) stays; of rows of one id and text any one. Texts without words all stay; nulls, ties and empty tables as in near_duplicates()."""
    scratch = Scratch(docs.sparkSession, "unique", docs)
    found = scratch.keep(near_duplicates(docs, **options), "classes")
    # texts without words have no links: each stays
    first = F.min(F.struct("_k", "_t"))
    stays = found.where("n_links > 0").groupBy("root").agg(first.alias("one")).select("one._k", "one._t")
    rest = found.where("n_links = 0").select("_k", "_t").distinct()
    many = found.groupBy("_k", "_t").agg(F.count("*").alias("_n"))
    stays = scratch.keep(stays.join(many, ["_k", "_t"]).withColumn("_one", F.col("_n") > 1).unionByName(rest.withColumns({"_n": F.lit(1).cast("long"), "_one": F.lit(False)})), "stays")
    rows = carried(docs).join(stays, ["_k", "_t"])
    # of rows that share their key one is taken before they move
    single = rows.where("_one").groupBy("_k", "_t").agg(F.first("_row").alias("_row"))
    rows = rows.where("not _one").select("_row").unionByName(single.select("_row"))
    return rows.select(*uncarried(rows, docs))
