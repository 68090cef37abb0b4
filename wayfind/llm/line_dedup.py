"""Line deduplication over the whole corpus. DataFrame functions only.

Lines leave their documents as hashes: (hash, document, position) rows are range-partitioned by hash and document, so a line
that fills a third of the corpus spreads over many ranges, and sorted within them by document and position. One pass over a
range marks the first occurrence in each document; only these are counted, combined before they move. The
result is one compressed bitmap per document that loses lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch, carried, row_key, uncarried

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """_k, _t (see row_key) and keep: (word, bits) of 64 lines each, a bit set for each line that stays; words without a line to drop are left out.

    A key of at least `least_chars` code points in at least `least_docs` documents keeps its lines only in the
    document of the largest id. Keys meet as 128 bits of hash.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines", docs)
    key = line_key(F.col("line"))
    long_lines = docs.select(*row_key(), lines_of(F.col("text")).alias("lines")).select("_k", "_t", F.posexplode("lines").alias("pos", "line")).where(F.length(key) >= least_chars)
    rows = long_lines.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key, F.length(key)).alias("h2"), "_k", "_t", "pos")
    # finding the ranges reads the rows once more: written, they are read and not taken from the texts again
    rows = scratch.keep(rows, "lines", "none")
    rows = rows.repartitionByRange(F.col("h1"), F.col("h2"), F.col("_k").desc())
    # all occurrences of a line in a document are in one range: the window streams over it in order and moves nothing
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "_k").orderBy("_t", "pos"))
    rows = scratch.keep(rows.withColumn("first", nth == 1), "occurrences")
    scratch.drop("lines")
    common = rows.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("_k").alias("owner")).where(F.col("docs") >= least_docs)
    # written, so that both sides of the join are plain shuffles, whose hot lines can be split
    common = scratch.keep(common, "common")
    gone = rows.join(common, ["h1", "h2"]).where(F.col("_k") != F.col("owner"))
    words = gone.groupBy("_k", "_t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("_k", "_t").agg(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """_row (see carried), n_lines, n_dropped and kept (the text without the dropped lines) of every row."""
    gone = F.expr("flatten(transform(keep, w -> transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 0), b -> 64 * w.word + b)))")
    at = carried(docs, lines_of(F.col("text")).alias("_lines")).join(bitmaps.select("_k", "_t", gone.alias("_gone")), ["_k", "_t"], "left")
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> get(_lines, i))")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept)
    size = F.size("_lines").cast("long")
    return at.withColumn("_left", kept).select("_row", size.alias("n_lines"), (size - F.size("_left")).alias("n_dropped"), F.array_join("_left", "\n").alias("kept"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Every row of docs as _row, with n_lines (before), n_dropped and kept (the text that is left).

    A null or empty text is one empty line. A null id counts as smaller than all others. Rows that repeat an id are one
    document where documents are counted, and each row stays in the result. An empty table gives no rows. Columns other
    than doc_id and text travel inside _row under any name.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the shortened texts, n_chars brought in line where it is there. What dedup_lines says of nulls, ties, repeated rows and empty tables holds here; a null text comes back empty."""
    done = dedup_lines(docs, **options)
    return done.select(*uncarried(done, docs, text=F.col("kept"), n_chars=F.length("kept").cast("long")))
