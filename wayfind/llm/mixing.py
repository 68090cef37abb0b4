"""Mixing sources to target weights by entropy balancing.

The rate of a document is exp(v * size / mean size of its source), at most `most`: the exponential tilt nearest to taking every
document once that meets the source's target. The convex dual in v, one number a source, is solved by Newton
iterations whose sums, words taken and their slope, are distributed aggregates over all documents of each source. Documents of one
source and exact size have one rate, and are counted together once, before the iterations. Rates are then rounded into copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import WORD, Scratch, carried, numbered, row_key, uncarried


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """Every row of sources (source, source_size and more, written beforehand) with target. Sources by code point, null last, take the weights in turn and share `share` of all sizes; none gets over `most` times its size, the rest reshared by weight.

    Resharing ends at min(cap, level * weight). Each round takes the level from one aggregate over the sources and caps those
    above, as many rounds as find any. Sources are numbered in ranges, so that no task has all of them.
    """
    nth = numbered(sources, [F.col("source").isNull(), F.col("source")], scratch, "sources", files=scratch.fewer)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    t = scratch.keep(nth.select("*", w.alias("_w"), (F.col("source_size") * float(most)).alias("_cap")).drop("_nth"), "weights", files=scratch.fewer)
    total = float(t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = (F.col("_cap") < level * F.col("_w")) | (F.col("_cap") == 0)
        caps, free, n = t.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w"))), F.count_if(over)).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (caps or 0.0)) / free
    own = F.col("_cap") if not free else F.least("_cap", F.lit(level) * F.col("_w"))
    return t.withColumn("target", own).drop("_w", "_cap")


def newton(hist: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """One safeguarded Newton step for all sources at once: state has _s, _n, source_size, target, scale, v (null: no step needed), low, high and done.

    In logarithms, log(taken(v)) = log(target): for a plain exponential that is nearly straight.
    """
    x = F.col("size") * F.col("scale")
    rate = F.least(F.lit(most), F.exp(F.least(F.col("v") * x, F.lit(50.0))))
    words = F.col("docs") * F.col("size") * rate
    kept = ["source_size", "target", "scale", "v", "low", "high", "done"]
    at = hist.join(state.hint("shuffle_hash"), ["_s", "_n"]).groupBy("_s", "_n").agg(F.sum(words).alias("taken"), F.sum(F.when(rate < most, words * x).otherwise(0.0)).alias("slope"), *[F.first(c).alias(c) for c in kept])
    miss = F.col("taken") - F.col("target")
    at = at.withColumn("done", F.col("v").isNull() | F.col("done") | (F.abs(miss) <= 1e-9 * F.col("target")))
    at = at.withColumns({"low": F.when(miss <= 0, F.col("v")).otherwise(F.col("low")), "high": F.when(miss > 0, F.col("v")).otherwise(F.col("high"))})
    step = F.when((F.col("slope") > 0) & (F.col("taken") > 0), F.col("v") - (F.log("taken") - F.log("target")) * F.col("taken") / F.col("slope"))
    wide = F.greatest(F.lit(1.0), F.abs("v"))
    safe = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(miss > 0, F.col("v") - wide).otherwise(F.col("v") + wide))
    inside = step.isNotNull() & (F.abs(step - F.col("v")) <= 4 * wide) & (step > F.coalesce("low", F.lit(-1e300))) & (step < F.coalesce("high", F.lit(1e300)))
    v = F.when(F.col("done"), F.col("v")).when(inside, step).otherwise(safe)
    return at.select("_s", "_n", *[v.alias("v") if c == "v" else c for c in kept])


def tilts(hist: DataFrame, aim: DataFrame, most: float, scratch: Scratch, steps: int = 4, rounds: int = 50) -> DataFrame:
    """_s, _n, source_size, target, scale and v of every source of aim (_s, _n, docs, source_size, target); v is null where every document's rate is `most`, or 1 as the source has no words. `steps` steps run between two looks at whether all are done."""
    open_ = (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    v = F.when(open_, F.greatest(F.lit(-4.0), F.log(F.col("target") / F.col("source_size"))))
    none = F.lit(None).cast("double")
    now = aim.select("_s", "_n", "source_size", "target", (F.col("docs") / F.greatest("source_size", F.lit(1))).alias("scale"), v.alias("v"), none.alias("low"), none.alias("high"), F.lit(False).alias("done"))
    for i in range(rounds):
        for _ in range(steps):
            now = newton(hist, now, most)
        now = scratch.keep(now, f"tilt{i}", few=4)
        if not now.where("not done").limit(1).count():
            return now
    raise RuntimeError(f"entropy balancing didn't end after {rounds * steps} steps")


def copies_of_sizes(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """A source's sizes with `total`, the copies that all documents of a size get: from large to small, each makes up for what the ones before it missed."""
    pdf = pdf.sort_values("size", ascending=False)
    n, size = pdf["docs"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
    v, full = pdf["v"].iloc[0], pdf["source_size"].iloc[0] > 0
    rates = np.full(len(n), float(most) if full else min(1.0, most)) if pd.isna(v) else np.minimum(most, np.exp(np.minimum(v * size * pdf["scale"].iloc[0], 50)))
    total, owed = np.zeros(len(n), np.int64), 0.0
    for i in range(len(n)):
        if not size[i]:
            total[i] = round(rates[i] * n[i])
            continue
        owed += rates[i] * n[i] * size[i]
        total[i] = min(most * n[i], max(0, round(owed / size[i])))
        owed -= float(total[i] * size[i])
    return pdf.assign(total=total)[["_s", "_n", "size", "docs", "source_size", "target", "total"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, group_rows: int = 250) -> DataFrame:
    """doc_id, source, _k, _t (see row_key), size, source_size, target (its source's) and copies (0 to `most`) of every row of docs.

    Rates are rounded into copies size by size, from large to small, each size making up for what the ones before it missed: a task
    has one source's sizes, whose number the longest document bounds. Within a size the rows with the smallest hashes of id and text get
    the odd copies; n such rows are dealt them in groups of about max(group_rows, sqrt(n)). Reruns agree. Null texts have
    size 0; a null source is a source, the last. Rows that repeat are documents of their own. An empty table gives no
    rows. Columns other than doc_id, text and source are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing", docs)
    rows = docs.select("doc_id", "source", *row_key(), size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h"))
    rows = scratch.keep(rows.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}), "rows")
    hist = scratch.keep(rows.groupBy("_s", "_n", "size").agg(F.count("*").alias("docs")), "histogram", files=scratch.fewer)
    named = hist.groupBy("_s", "_n").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("size")).alias("source_size")).withColumn("source", F.when(~F.col("_n"), F.col("_s")))
    aim = targets(scratch.keep(named, "named", files=scratch.fewer), weights, share, most, scratch)
    tilt = tilts(hist, aim, float(most), scratch).select("_s", "_n", "source_size", "target", "scale", "v")
    solved = hist.join(tilt.hint("shuffle_hash"), ["_s", "_n"]).groupBy("_s", "_n").applyInPandas(lambda pdf: copies_of_sizes(pdf, most), "_s string, _n boolean, size long, docs long, source_size long, target double, total long")
    solved = scratch.keep(solved, "solved")
    # odd copies per salted group: running counts over the groups of a size fix each group's part
    salts = F.ceil(F.col("docs") / F.greatest(F.lit(float(group_rows)), F.sqrt("docs")))
    # a table with a row for every size of a source isn't one to broadcast; hot sizes are split as the join reads them
    joined = scratch.keep(rows.join(solved.hint("merge"), ["_s", "_n", "size"]).withColumn("_salt", F.pmod("_h", salts)), "joined")
    scratch.drop("rows")
    groups = joined.groupBy("_s", "_n", "size", "_salt").agg(F.count("*").alias("count"), F.first("docs").alias("docs"), F.first("total").alias("total"))
    run = Window.partitionBy("_s", "_n", "size").orderBy("_salt")
    groups = groups.withColumns({"upto": F.sum("count").over(run), "odd": F.col("total") % F.col("docs")})
    part = F.expr("(upto * odd) div docs - ((upto - count) * odd) div docs")
    dealt = groups.select("_s", "_n", "size", "_salt", part.alias("_odd"))
    nth = F.row_number().over(Window.partitionBy("_s", "_n", "size", "_salt").orderBy("_h", "_k", "_t"))
    copies = F.expr("total div docs") + F.when(nth <= F.col("_odd"), 1).otherwise(0)
    out = joined.join(dealt.hint("merge"), ["_s", "_n", "size", "_salt"]).withColumn("copies", copies.cast("int"))
    # written with a file a shuffle partition, the result would start several processes for each on some file systems
    return out.select("doc_id", "source", "_k", "_t", "size", "source_size", "target", "copies").coalesce(scratch.files)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as it is copied."""
    scratch = Scratch(docs.sparkSession, "mixed", docs)
    # rows of one id and text are interchangeable: their copies are added up and dealt out again
    total = scratch.keep(mix(docs, **options).groupBy("_k", "_t").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows")).where("_sum > 0"), "copies")
    rows = carried(docs).join(total, ["_k", "_t"])
    n = F.expr("_sum div _rows")
    # a row alone takes all; of rows that share their key, those of each written part are numbered after those before it
    again = scratch.keep(total.where("_rows > 1"), "again")  # known to be small where it is: docs then need no second shuffle
    many = scratch.keep(carried(docs).join(again, ["_k", "_t"]).withColumn("_p", F.spark_partition_id()), "many")
    parts = many.groupBy("_k", "_t", "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_k", "_t").orderBy("_p")) - F.col("_c")
    nth = F.row_number().over(Window.partitionBy("_k", "_t", "_p").orderBy(F.xxhash64("_row")))
    many = many.join(parts.select("_k", "_t", "_p", before.alias("_before")), ["_k", "_t", "_p"]).withColumn("_c", n + F.when(nth + F.col("_before") <= F.col("_sum") % F.col("_rows"), 1).otherwise(0))
    rows = rows.where("_rows = 1").select("_row", n.alias("_c")).unionByName(many.select("_row", "_c")).where("_c > 0")
    rows = rows.withColumn("_c", F.explode(F.expr("sequence(1L, cast(_c as bigint))")))
    return rows.select(*uncarried(rows, docs))
