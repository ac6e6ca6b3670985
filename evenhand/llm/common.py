"""Shared pieces of the training-data operators: scratch tables, words, hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_OWN_DIR: dict[str, str] = {}
_SWEPT: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="evenhand-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder. It lives until the session ends."""
    path = f"{checkpoint_root(spark)}/evenhand/{label}-{uuid.uuid4().hex[:12]}"
    _SWEPT.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _SWEPT:
        try:
            delete(spark, path)
        except Exception:  # the gateway may be gone at exit; the folder is then left to the cluster's own cleaning
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    few: in four files a core at most, however many partitions there are, for tables of short rows that are written again
    and again. On a local file system each file costs a forked process, which for a moment counts an executor's memory twice.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 65_536, size: str = "4m") -> None:
    """Batches for Python workers are bounded by bytes too, so that long texts keep to bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


KEY = ["__id", "__text"]
_NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """`row`, all columns of docs as a struct whatever their names, and a row's key: its id, the least for null, and a hash of its text.

    Rows that repeat an id with another text have keys of their own; rows that repeat both share one.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.withColumns({"__id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)), "__text": F.xxhash64("row.text", F.col("row.text").isNull())})


def id_of(key: Column) -> Column:
    """The id of a key's first part: null for the least."""
    return F.when(key != _NO_ID, key)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(F.length(stripped) == 0, F.lit(0)).otherwise(F.size(F.split(stripped, GAP))).cast("long")


def remainder5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(5))


def sliced(texts, limit: int = 250_000):
    """(from, to) ranges of a batch holding about `limit` characters each, one text at least.

    Arrays of a slice stay small, so that a worker's memory isn't left in pieces.
    """
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give a Python worker's freed memory back to the system: idle workers would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def texts_of(series) -> list[str]:
    return [x if isinstance(x, str) else "" for x in series]


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _MIX1
        x = x ^ (x >> np.uint64(33))
        x = x * _MIX2
        return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse ** i, modulo 2 ** 64; base is odd."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        held = tuple(np.ones(max(n, 1 << 16), np.uint64) for _ in range(2))
        with np.errstate(over="ignore"):
            for out, factor in zip(held, (base, pow(base, -1, 1 << 64))):
                out[1:] = np.uint64(factor)
                np.multiply.accumulate(out, out=out)
        _POWERS[base] = held
    return held[0][:n], held[1][:n]


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of the stretches [start, end) of 64-bit values: polynomials from prefix sums, mixed with the length."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * power[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of all texts, in order: their hashes, and their places in the texts' UTF-8 bytes, joined by line breaks.

    lower: A to Z count as a to z.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw)
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.text_ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[self.data]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = stretch_hashes(_BYTE[self.data], self.starts, self.ends)
        #: words of each text
        self.sizes = np.diff(np.searchsorted(self.starts, self.text_ends), prepend=0)


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    words = Words(texts, lower)
    return words.hashes, words.sizes
