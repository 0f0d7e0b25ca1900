"""What several operators share: reading columns safely, hashing, batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python chunk works on.
CHUNK_BYTES = 4 << 20

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns can't clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds: long texts come in smaller batches (the session's lower setting is kept)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if int(size.sum()) <= limit:
            yield b
            continue
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def release() -> None:
    """Give freed memory back to the system: Python workers serve one stage after the other, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, with freed memory given back at each task's end."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over an array."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: Each bit of a byte in a byte of its own: sums of up to 255 rows fit.
_SPREAD = np.array([sum(((v >> (7 - i)) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def bit_sums(bits: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each group of rows (from begin[i] up to begin[i + 1]): how many have each bit set. bits: (n, k) bytes."""
    size = np.diff(np.append(begin, len(bits)))
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(begin - 255 * first, parts) + 255 * np.arange(int(parts.sum()))
    some = np.ascontiguousarray(np.add.reduceat(_SPREAD[bits], cuts, axis=0)).view(np.uint8)
    return np.add.reduceat(some, first, axis=0, dtype=np.int32)
