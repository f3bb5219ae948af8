"""What several operators share: the shared folder, staged tables, bounded bitmaps, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.workers import importable

#: Rows of one Arrow batch: a batch of long texts must still fit beside a small executor heap.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``; where that is unset, as in tests on one machine, one of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="threadmill-")
    return _OWN[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    to = fresh_dir(spark, name)
    df.write.parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out.staged_at = to
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, never raising what the user set lower."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for what is run inside."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Membership bitmap of a long column of hashes: ``2**bits`` bits whatever the number of keys.

    The bits are OR-ed by Spark; the driver gets at most ``2**bits / 64`` rows. No key is missed;
    a key that is absent passes with a probability that grows with the fill.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % column).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    words = np.zeros(max(1, (1 << bits) >> 6), dtype=np.int64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) != 0


def _trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that leaves its worker small: workers outlive their tasks and share an executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return wrapped


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def by_bytes(at: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most so many bytes; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def crc32_text(c: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null stays null."""
    return F.crc32(c.cast("binary"))


def hash60(*parts: Column) -> Column:
    """A 60-bit hash of strings that other SQL engines can recompute: the head of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
