"""Substring deduplication: repeated windows of words as edges of a de Bruijn graph, compacted into nonbranching paths.

The graph's k-mers are the windows of `window` words. Each is an edge from the node of all its words but the last to the node of
all but the first. Only edges found twice or more matter, and sampling finds the places where they can be:

1. Every window has an anchor, the sampled mer of words in it whose hash is least (the leftmost of equals), so equal windows have
   equal anchors at equal places. Consecutive windows of a document with one anchor are a run, its words a region. Runs
   whose anchor is found once hold no repeated window and drop out.
2. Equal regions, by 128 bits of digest of their words, are one: the edges of one representative stand for all of them, with
   their number as weight. An edge is 128 bits of digest of the window's words; the weights of equal edges add up, and
   those of two and more stay.
3. The degrees of the nodes between the edges that stay tell where paths branch. Joins bring edges and degrees
   back to the regions, as bitmaps of what repeats and of where a path ends.
4. A join takes the regions' bitmaps to the source coordinates of all runs, and adjacent parts of one nonbranching path become
   one span. A span counts only if the words at its coordinates have the region's digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import Rolling, Scratch, row_key, slices, tidy

BASE = 0x9E3779B97F4A7C15
#: Windows of one run, each a bit of a long.
MOST = 64


def _record(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class Words:
    """The words of some texts: `flat` has them joined by single spaces, each starts at `byte` there (one more entry at the end), each text's words at `first` (one more, too)."""

    #: 1 for all but ASCII white space.
    HELD = bytes(int(i not in b" \t\n\r\x0b\x0c") for i in range(256))

    def __init__(self, texts: list[bytes]):
        blob = b" ".join([*texts, b""])
        held = np.frombuffer(blob.translate(self.HELD), bool)
        starts = held.copy()
        starts[1:] &= ~held[:-1]
        stays = held.copy()
        stays[1:] |= held[:-1]  # of white space the first character, made a space
        self.bytes = np.where(held, np.frombuffer(blob, np.uint8), np.uint8(32))[stays]
        self.flat = memoryview(self.bytes.tobytes())
        self.byte = np.append(np.flatnonzero(starts[stays]), len(self.bytes))
        text = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(np.flatnonzero(starts), text)

    def __len__(self) -> int:
        return len(self.byte) - 1

    def hashes(self, roll: Rolling):
        """A function of starts and counts: 64-bit hashes of that many words, in which equal words are equal; good for sampling, not for proof."""
        sums = roll.sums(self.bytes)
        return lambda start, count: roll.of(sums, self.byte[start], self.byte[start + count])

    def digests(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Two longs of digest of the words from each start on."""
        cuts = map(slice, self.byte[start].tolist(), (self.byte[start + count] - 1).tolist())
        found = b"".join(map(xxhash.xxh3_128_digest, map(self.flat.__getitem__, cuts)))
        return np.frombuffer(found, "<i8").reshape(-1, 2)


def leftmost_least(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each place, where in the `reach` places from it on the least hash is, by its upper 32 bits; the leftmost of equals."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


RUNS = "_k long, _t binary, start long, windows int, anchor long, r1 long, r2 long"


def runs(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """Key, start, number of windows, anchor and region (r1, r2) of every run of every row."""

    def find(batches):
        roll = Rolling(BASE)
        for part, texts in slices(batches, "text"):
            words = Words(texts)
            n = len(words)
            if n < window:
                continue
            doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
            mers = words.hashes(roll)(np.arange(n - mer + 1), mer)
            starts = np.arange(n - window + 1)
            starts = starts[doc[starts] == doc[starts + window - 1]]
            if not len(starts):
                continue
            anchor = leftmost_least(mers, window - mer + 1)[starts]
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(starts)))
            s0 = starts[head]
            d = pa.array(doc[s0])
            region = words.digests(s0, count - 1 + window)
            key = {"_k": part.column(0).take(d), "_t": part.column(1).take(d)}
            own = {"start": pa.array(s0 - words.first[doc[s0]], pa.int64()), "windows": pa.array(count, pa.int32()), "anchor": pa.array(mers[anchor[head]].view(np.int64))}
            yield _record({**key, **own, "r1": pa.array(region[:, 0]), "r2": pa.array(region[:, 1])})

    return docs.select(*row_key(), "text").mapInArrow(tidy(find), RUNS)


EDGES = "e1 long, e2 long, source long, target long, r1 long, r2 long, at int, weight long"


def edges(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The edge (e1, e2), its nodes, region, place in the region and weight of each window of the wanted runs: _k, _t, runs (array of start, windows, weight, r1, r2)."""

    def emit(batches):
        roll = Rolling(BASE)
        for part, texts in slices(batches, "text"):
            words = Words(texts)
            hashes = words.hashes(roll)
            lists = part.column(3)
            of = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(lists)))
            flat = lists.flatten()
            start, count = np.asarray(flat.field(0)), np.asarray(flat.field(1)).astype(np.int64)
            row = np.repeat(np.arange(len(of)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            s = words.first[of[row]] + start[row] + at
            edge = words.digests(s, np.full(len(s), window))
            node = lambda x: pa.array(hashes(x, window - 1).view(np.int64))
            place = pa.array(row)
            own = {"r1": flat.field(3).take(place), "r2": flat.field(4).take(place), "at": pa.array(at, pa.int32()), "weight": flat.field(2).take(place)}
            yield _record({"e1": pa.array(edge[:, 0]), "e2": pa.array(edge[:, 1]), "source": node(s), "target": node(s + 1), **own})

    texts = docs.select(*row_key(), "text").join(wanted, ["_k", "_t"]).select("_k", "_t", "text", "runs")
    return texts.mapInArrow(tidy(emit), EDGES)


def repeated_runs(docs: DataFrame, window: int, scratch: Scratch, mer: int = 12) -> DataFrame:
    """_k, _t and runs of every document with a repeated window: an array of start, windows, r1, r2 (the run's region), again (a bit for each window that repeats) and ends (for each behind which its path ends)."""
    mer = min(window, max(mer, window + 1 - MOST))
    found = scratch.keep(runs(docs, window, mer), "runs")
    anchors = scratch.keep(found.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    # both sides of each join below are written tables and so plain shuffles, whose hot keys can be split
    candidates = scratch.keep(found.join(anchors, "anchor").drop("anchor"), "candidates")
    scratch.drop("runs", "anchors")
    regions = candidates.groupBy("r1", "r2").agg(F.count("*").alias("weight"), F.min(F.struct("_k", "_t", "start", "windows")).alias("one"))
    run = F.struct("one.start", "one.windows", "weight", "r1", "r2")
    wanted = scratch.keep(regions.select("one._k", "one._t", run.alias("run")).groupBy("_k", "_t").agg(F.collect_list("run").alias("runs")), "wanted")
    every = scratch.keep(edges(docs, wanted, window), "edges")
    scratch.drop("wanted")
    kmers = every.groupBy("e1", "e2").agg(F.sum("weight").alias("m"), F.min("source").alias("source"), F.min("target").alias("target")).where("m > 1").drop("m")
    kmers = scratch.keep(kmers, "kmers")
    ends = kmers.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(kmers.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    branching = scratch.keep(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or in > 1").select("node", F.lit(True).alias("end")), "branching")
    kmers = kmers.select("e1", "e2", F.col("target").alias("node")).join(branching, "node", "left").select("e1", "e2", F.coalesce("end", F.lit(False)).alias("end"))
    kmers = scratch.keep(kmers, "compact")
    scratch.drop("kmers", "branching")
    bit = F.expr("shiftleft(1L, at)")
    again = every.select("e1", "e2", "r1", "r2", "at").join(kmers, ["e1", "e2"]).groupBy("r1", "r2")
    again = scratch.keep(again.agg(F.bit_or(bit).alias("again"), F.bit_or(F.when(F.col("end"), bit).otherwise(0)).alias("ends")), "again")
    scratch.drop("edges", "compact")
    run = F.struct("start", "windows", "r1", "r2", "again", "ends")
    out = scratch.keep(candidates.join(again, ["r1", "r2"]).groupBy("_k", "_t").agg(F.collect_set(run).alias("runs")), "spans")
    scratch.drop("candidates", "again")
    return out


def path_spans(lists: pa.ListArray, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (among those of all texts) and windows of each nonbranching path of repeated windows, from the runs of each text; runs whose digest is not that of the words at their coordinates are left out."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    doc = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.flatten()
    start, windows, r1, r2, again, ends = (np.asarray(flat.field(i)).astype(np.int64) for i in range(6))
    start += words.first[doc]
    inside = np.flatnonzero(start + windows + window - 1 <= words.first[doc + 1])
    found = words.digests(start[inside], windows[inside] + window - 1)
    own = inside[(found[:, 0] == r1[inside]) & (found[:, 1] == r2[inside])]
    row = np.repeat(own, windows[own])
    bit = np.arange(len(row)) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
    repeats = (again[row] >> bit & 1).astype(bool)
    row, bit = row[repeats], bit[repeats]
    at = start[row] + bit
    order = np.argsort(at, kind="stable")
    at, row, bit = at[order], row[order], bit[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (ends[row[:-1]] >> bit[:-1] & 1).astype(bool) | (doc[row[1:]] != doc[row[:-1]])
    head = np.flatnonzero(new)
    return doc[row[head]], at[head], np.diff(np.append(head, len(at)))


def _each(docs: DataFrame, window: int, mer: int, schema: str, of) -> DataFrame:
    """of(doc_ids, texts, words, spans) for slices of all rows of docs."""
    found = repeated_runs(docs, window, Scratch(docs.sparkSession, "substrings", docs), mer)

    def run(batches):
        for part, texts in slices(batches, "text"):
            words = Words(texts)
            yield of(part.column(0), texts, words, path_spans(part.column(2), words, window))

    rows = docs.select(F.col("doc_id").cast("long"), *row_key(), "text").join(found, ["_k", "_t"], "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(tidy(run), schema)


def repeated_spans(docs: DataFrame, window: int = 35, mer: int = 12) -> DataFrame:
    """doc_id, start (in words), n_words, and h1, h2 (128 bits of digest of the words) of every occurrence of a nonbranching path of repeated windows.

    What holds for remove_repeats holds here too. A path may start or end inside another document's: h1 and h2 are equal where the words are.
    """

    def rows(doc_ids, texts, words, spans):
        doc, at, windows = spans
        n = windows + window - 1
        h = words.digests(at, n)
        return _record({"doc_id": doc_ids.take(pa.array(doc)), "start": pa.array(at - words.first[doc]), "n_words": pa.array(n), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1])})

    return _each(docs, window, mer, "doc_id long, start long, n_words long, h1 long, h2 long", rows)


def remove_repeats(docs: DataFrame, window: int = 35, mer: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by one space) of every row.

    A word goes if a window over it has a word sequence that also starts anywhere else, in the same document or another.
    Windows are judged on the input. Null and short texts have no window and keep their words; rows that repeat are
    copies of each other; null ids are kept apart by their texts; an empty table gives no rows; columns other than doc_id
    and text are ignored.
    """

    def rows(doc_ids, texts, words, spans):
        _, at, windows = spans
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + windows + window - 1, -1)
        stays = np.cumsum(edge)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(stays)])[words.first]
        length = np.diff(words.byte)
        kept = words.bytes[np.repeat(stays, length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(stays, length, 0))])[words.first].tolist()
        texts = pa.array([kept[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])], pa.binary()).cast(pa.string())
        n = np.diff(words.first)
        return _record({"doc_id": doc_ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(left), pa.int64()), "kept": texts})

    return _each(docs, window, mer, "doc_id long, n_words long, n_removed long, kept string", rows)
