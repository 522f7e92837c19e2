"""What several operators of this subpackage share: checkpoints, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..saving import drop_folder, forget, new_folder, saved, shared_folder  # noqa: F401

#: Text bytes that one step of an Arrow function works on at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: The same where a text takes tens of times its bytes while it is worked on.
PIECE_BYTES = 256 << 10
#: Words whose hash a Python worker keeps; the cache is emptied when it is full.
CACHE_WORDS = 150_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def least_hashed(df: DataFrame, n: int, *keys: str, count: int | None = None) -> DataFrame:
    """At most n rows, those of least hash of the keys, in a fixed choice.

    A threshold on the hash, from the number of rows, leaves a few times n rows before any are gathered.
    """
    spread = F.xxhash64(*keys)
    share = min(1.0, 4 * n / max(1, df.count() if count is None else count))
    return df.where(F.pmod(spread, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(spread, F.lit(1 << 30)), *keys).limit(n)


def within_bytes(df: DataFrame, most: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The first rows, in the order, whose texts have at most `most` bytes together (of each value of `by`); the others go whole.

    For samples: few rows, whose texts may be of any length.
    """
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__bytes", F.sum(F.octet_length("text")).over(window)).where(F.col("__bytes") <= most).drop("__bytes")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each piece have at most `most` bytes (one row at least)."""
    for batch in batches:
        yield from pieces(batch, column, most)
    release()


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """One batch, cut as steps() does."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)
    ends = ends[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives back what a Python worker no longer needs. Workers live on between tasks and stages, and would hold the memory of
    their largest batch, besides the JVM's, until the session ends."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Hashes(dict):
    """XXH64 of byte strings, kept for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = Hashes()
#: glibc's way to return freed pages; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (xor, shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every run of `width` values; out[i] covers values[i : i + width]."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, have, level, done, left = np.uint64(0x9E3779B97F4A7C15), None, values.astype(np.uint64), 0, width
        span, step = 1, power
        while left:
            if left & 1:
                if have is None:
                    have, done = level, span
                else:
                    n = min(len(have), len(level) - done)
                    have, done = have[:n] * step + level[done : done + n], done + span
            left >>= 1
            if left:
                n = len(level) - span
                level, span, step = level[:n] * step + level[span:], span * 2, step * step
        return mix(have[: len(values) - width + 1])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand at most `rows` texts at once to Python (texts are far larger than the usual row)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
