"""Exact top-k search by inner product: tiles of candidate vectors times blocks of query vectors.

Vectors are packed into matrix tiles where they are read, so that what moves is a few large rows. Every query block
meets every shard of tiles once, in a task that multiplies tile after tile, keeps the k best per query and tile and merges
them into a running list. The lists of the shards then meet in a tree of window selections, `fanin` lists at a time, so no
task ever holds more than fanin * k rows of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import tidy

TILE = "tile long, n long, dim long, ids binary, matrix binary"
TILE_BYTES = 16 << 20
LARGEST = float(np.finfo(np.float64).max)
HITS = "query_id long, vec_id long, score long, shard long"


def _pack(ids: np.ndarray, matrix: np.ndarray, rows: int) -> pa.RecordBatch:
    out = []
    rows = max(1, min(rows, TILE_BYTES // (8 * max(1, matrix.shape[1]))))
    for at in range(0, len(ids), rows):
        part = np.ascontiguousarray(matrix[at : at + rows])
        own = np.ascontiguousarray(ids[at : at + rows])
        out.append((xxhash.xxh3_64_intdigest(own.tobytes()) >> 1, len(own), part.shape[1], own.tobytes(), part.tobytes()))
    names = [x.split()[0] for x in TILE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def tiles(vectors: DataFrame, vec_id: str, embedding: str, scale: float, rows: int) -> DataFrame:
    """Packed float64 tiles of floor(scale * x), by vector length. Null vectors, and those with null or non-finite components, are left out."""

    def pack(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
            known = np.asarray(ids.is_valid())
            for dim in np.unique(sizes[sizes >= 0]):
                at = np.flatnonzero((sizes == dim) & known)
                taken = column.take(pa.array(at))
                flat = taken.flatten().cast(pa.float64())
                x = np.asarray(flat.fill_null(math.nan)).reshape(len(at), int(dim))
                good = np.isfinite(x).all(axis=1)
                with np.errstate(all="ignore"):  # a finite component that overflows is the largest double of its sign
                    x = np.clip(np.floor(scale * x), -LARGEST, LARGEST)
                if good.any():
                    own = np.asarray(ids.take(pa.array(at)).cast(pa.int64()))[good]
                    yield _pack(own, x[good], rows)

    return vectors.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(tidy(pack), TILE)


def _best(query_ids, queries, ids, matrix, k):
    """(query position, candidate id, score) of the k best of one tile for each query, the query's own id left out; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    bound = (np.abs(queries).max(initial=0)) * (np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
    if bound < 2.0**52:
        scores = queries @ matrix.T  # every partial sum is an exact double
        exact = scores.astype(np.int64)
    else:
        whole = [[int(v) for v in row] for row in matrix]
        exact = np.empty((len(queries), len(matrix)), dtype=object)
        for i, q in enumerate(queries):
            q = [int(v) for v in q]
            exact[i] = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, row)))) for row in whole]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(first) < len(ids):  # rows that repeat an id take one place, before the k best are cut
        ids, exact = ids[first], np.maximum.reduceat(exact, first, axis=1)
        if bound < 2.0**52:
            scores = exact.astype(np.float64)
    out = []
    fast = bound * (len(ids) + 1) < 2.0**52
    if fast:  # score and place in one exact number: ties are gone
        keyed = scores * (len(ids) + 1) - np.arange(len(ids))
        own = query_ids[:, None] == ids[None, :]
        keyed[own] = -np.inf
        kk = min(k, len(ids))
        top = np.argpartition(-keyed, kk - 1, axis=1)[:, :kk]
        q = np.repeat(np.arange(len(queries)), kk)
        c = top.ravel()
        keep = ~own[q, c]
        return q[keep], ids[c[keep]], exact[q[keep], c[keep]]
    for i in range(len(queries)):
        others = np.flatnonzero(ids != query_ids[i])
        best = sorted(others, key=lambda j: (-exact[i, j], j))[:k]
        out += [(i, ids[j], exact[i, j]) for j in best]
    q, c, s = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    return q, c, s


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: float = 1024.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tile_rows: int = 2048,
    query_rows: int = 1024,
    shard_bytes: int = 128 << 20,
    part_bytes: int = 64 << 20,
    fanin: int = 16,
) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * x). A row never answers a query of its own id. Null ids, null vectors and vectors
    with a null or non-finite component take no part; only vectors of equal length meet. Rows that repeat an id count
    once per query, with their best score. Ties go to the smaller id. Scores beyond 64 bits saturate. An empty table, or
    one without a usable query, gives no rows. Other columns of the tables are ignored.
    """
    held = [F.count("*"), F.sum(F.greatest(F.size(embedding), F.lit(1)).cast("long"))]
    (n, size), (_, asked) = vectors.agg(*held).first(), queries.agg(*held).first()
    shards = max(1, math.ceil(8 * (size or 0) / shard_bytes), min(6, math.ceil(n / tile_rows)))
    parts = max(1, math.ceil(8 * (asked or 0) / part_bytes))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    own = lambda k: F.pmod(F.xxhash64("tile", "dim"), F.lit(k))
    # a grid of tasks: each has one shard of the candidates and one part of the queries, both bounded in bytes
    cand = tiles(vectors, vec_id, embedding, scale, tile_rows).withColumn("shard", own(shards)).withColumn("part", every(parts))
    blocks = tiles(queries, vec_id, embedding, scale, query_rows).withColumn("part", own(parts)).withColumn("shard", every(shards))

    def meet(key, left, right):
        shard = key[0]
        found = []

        def table(t):
            for n_, dim, ids, matrix in zip(t.column("n").to_pylist(), t.column("dim").to_pylist(), t.column("ids").to_pylist(), t.column("matrix").to_pylist()):
                yield dim, np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.float64).reshape(n_, dim)

        for dim, q_ids, q in table(left):
            run = [np.empty(0, np.int64)] * 3
            for c_dim, ids, matrix in table(right):
                if c_dim == dim:
                    hits = _best(q_ids, q, ids, matrix, k)
                    run = [np.concatenate([a, np.asarray(b, dtype=np.int64)]) for a, b in zip(run, hits)]
                    if len(run[0]) > 4 * k * len(q_ids):
                        run = _merge(run, k)
            at, ids, scores = _merge(run, k)
            found.append(pa.table({"query_id": q_ids[at], "vec_id": ids, "score": scores, "shard": np.full(len(at), shard.as_py(), np.int64)}))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score", "shard")})
        return pa.concat_tables([empty, *found])

    hits = blocks.groupBy("shard", "part").cogroup(cand.groupBy("shard", "part")).applyInArrow(meet, HITS)
    lists = shards
    while lists > 1:
        hits = hits.withColumn("shard", F.floor(F.col("shard") / fanin))
        lists = math.ceil(lists / fanin)
        if lists > 1:
            hits = _select(hits, k, "query_id", "shard")
    return _select(hits, k, "query_id").select("query_id", "rank", "vec_id", "score")


def _merge(run, k):
    at, ids, scores = run
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (at[1:] == at[:-1]) & (ids[1:] == ids[:-1])
    at, ids, scores = at[~same], ids[~same], scores[~same]
    first = np.searchsorted(at, at, side="left")
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[keep], scores[keep]


def _select(hits: DataFrame, k: int, *by: str) -> DataFrame:
    hits = hits.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))  # rows that repeat an id take one place
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
