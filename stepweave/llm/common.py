"""Shared helpers of the training-data operators: table access, checkpoints, batching and rolling hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that str.split, bytes.split and the regular expression [\x20\x09-\x0D] agree on as white space.
ASCII_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.isin(np.arange(256), ASCII_SPACE)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local session, where driver and executors are one process, may do without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, most: int = 8_000_000) -> None:
    """Bound the Arrow batches that JVM and Python workers exchange by bytes; rows may be long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages survive lost executors and never run the upstream twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """A checkpoint in no more partitions than its number of rows asks for, so that small tables make few shuffle files."""
    df = checkpoint(df)
    return df.coalesce(df.count() // rows_each + 1)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores after it if a column has it (Spark's names know no capitals)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column that is different in every row, and its name: doc_id itself where no row repeats or lacks it.

    Else the rows are numbered as a checkpoint holds them, so that the numbers stay the same.
    """
    key = fresh("row_key", docs.columns)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return checkpoint(docs.withColumn(key, F.monotonically_increasing_id())), key


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` holds about `most` bytes in each; a single longer row stays whole.

    Free memory goes back to the system before and after.
    """
    trim()
    for batch in batches:
        col = batch.column(column)
        n = batch.num_rows
        if not n:
            continue
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + n + 1].astype(np.int64))
        part = (np.cumsum(sizes) - sizes) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, n], strict=True):
            yield batch.slice(a, b - a)
    trim()


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the n + 1 offsets into them; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def trim() -> None:
    """Give memory that is free again back to the system; workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def rolled(v: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k values, mixed; len(v) - k + 1 of them. Built by doubling."""
    if len(v) < k:
        return np.empty(0, np.uint64)
    h, size, out, done = v.astype(np.uint64, copy=False), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                n = min(len(out), len(h) - done)
                out, done = out[:n] * np.uint64(pow(int(_ODD), size, 1 << 64)) + h[done : done + n], done + size
        if done == k:
            return mix(out)
        h = h[:-size] * np.uint64(pow(int(_ODD), size, 1 << 64)) + h[size:]
        size *= 2


def span_hashes(v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of v[start:end] for each span, from one prefix sum of terms v[i] * odd ** i."""
    n = len(v)
    powers = np.full(n + 1, _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * powers[:n], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space within each row: starts, ends, and n + 1 offsets of rows into them."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


