"""What the operators of this subpackage share: scratch tables, text slicing, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's rule for words, in Java syntax: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set to a new local one only where that is unset and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="wayfind-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: For queries that run inside lean(): shuffle files go when a query ends, not when the driver happens to collect its
#: garbage, and Python workers get their rows in batches of bounded bytes, however long texts are.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def lean(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def tidy(run):
    """A function for mapInArrow that, once its task is over, gives memory back before its worker waits for the next."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Bytes of input for each file of a written table.
FILE_BYTES = 64 << 20


def file_count(docs: DataFrame) -> int:
    """Files for a table made from docs: two for each core, or more as the input needs. Small files cost a process each to create on some file systems, and a task each to read."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(2**30, max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))))


class Scratch:
    """Written tables that cut lineage, in the shared folder. What a later step has used up can be dropped; the rest goes when the driver's Python ends. docs: what the tables are made from, which gives their number of files."""

    def __init__(self, spark: SparkSession, name: str, docs: DataFrame | None = None):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/wayfind-{name}-{uuid.uuid4().hex}"
        self.files = 2**30 if docs is None else file_count(docs)
        self.fewer = -(-self.files // 3)  # for tables with a row for many of docs
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", files: int | None = None, few: int | None = None) -> DataFrame:
        """df, written and read again, in at most `files` files. few: for tables of few rows, files that a small shuffle of its own fills, so that the steps before keep all their tasks."""
        path = f"{self.root}/{name}"
        with lean(self.spark):
            write = (df.repartition(few) if few else df.coalesce(min(files or self.files, self.files))).write
            write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")


def digest(*columns: Column) -> Column:
    """128 bits of some string columns, null and empty told apart where there are several."""
    if len(columns) == 1:
        return F.unhex(F.md5(columns[0]))
    return F.unhex(F.md5(F.concat(*[F.md5(F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))) for c in columns])))


def row_key(text: str = "text", doc_id: str = "doc_id", *more: str) -> list[Column]:
    """Names a row for joins, so that rows that repeat an id don't mix their texts: its id (null: the smallest long), and of its
    text, and of more columns, 128 bits of digest where the id is null, 64 where it is not."""
    whole = digest(F.coalesce(F.col(text), F.lit("")), *[F.col(c) for c in more])
    return [
        F.coalesce(F.col(doc_id), F.lit(-(2**63))).cast("long").alias("_k"),
        F.when(F.col(doc_id).isNull(), whole).otherwise(F.substring(whole, 1, 8)).alias("_t"),
    ]


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str, files: int | None = None) -> DataFrame:
    """Every row of df with _nth, its place from 0 in the given order: ranges of rows are counted apart, and only their counts reach the driver. files: see Scratch.keep."""
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), name, files=files)
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # one row a partition
    first = [sum(c for q, c in counts.items() if q < p) for p in range(max(counts, default=0) + 1)]
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_nth", nth + F.element_at(F.lit(first), F.col("_p") + 1)).drop("_p")


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """_row (a struct of all columns, whatever their names), _k, _t, and more."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *row_key(), *more)


def uncarried(rows: DataFrame, docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of docs out of _row, some replaced."""
    return [instead[c].alias(c) if c in instead else F.col("_row")[c].alias(c) for c in docs.columns]


def slices(batches, text: str, size: int = SLICE_BYTES):
    """Arrow batches cut so that their texts hold about size bytes: yields (batch, texts as bytes; null as empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            part = batch.slice(start, stop - start)
            texts = part.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            yield part, [x or b"" for x in texts]
            start = stop


class WordHash(dict):
    """64-bit hash of a word, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and where each text starts (one more entry at the end)."""
    words = [x.split() for x in texts]  # bytes.split() takes exactly the ASCII white space of WORD
    offsets = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in words], out=offsets[1:])
    flat = np.fromiter((cache[w] for x in words for w in x), dtype=np.uint64, count=int(offsets[-1]))
    return flat, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any run of words from prefix sums of hash * base ** position, modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, step, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])
