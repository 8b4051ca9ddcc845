"""Shared helpers of the training-data operators: shared-folder tables and vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a table over byte values.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is set where the setting is missing and all tasks run on
    this machine, as in tests; a cluster without it is an error, since its machines don't share their folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="sparkomics-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of tables that a run gives back before the application ends, by the run's name.
_OWNED: dict[str, list[str]] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is stored within belongs to the owner, until it is released."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table goes when the application ends, or, without `keep`, when its owner is released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkomics-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop)
    if not keep and (owner := _OWNER.get()):
        _OWNED.setdefault(owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, owner: str) -> None:
    """Delete the tables that the owner has stored; no result of its that reads them may still be wanted."""
    for path in _OWNED.pop(owner, []):
        hadoop, files = _hadoop(spark, path)
        files.delete(hadoop, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count or not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes together, or a single longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1023, _BASE)]), dtype=np.uint64)


def _powers(k: np.ndarray) -> np.ndarray:
    p = _POWERS[k & 1023]
    if len(k) and (top := int(k.max()) >> 10):
        step = int(_POWERS[1023]) * int(_BASE) % 2**64
        far = np.array([pow(step, i, 2**64) for i in range(top + 1)], dtype=np.uint64)
        p = p * far[k >> 10]
    return p


class Words(NamedTuple):
    """Words of several rows in order: hash, first byte, bytes; and the number of words before each row."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    before: np.ndarray


def hash_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE, lower: np.ndarray = LOWER) -> Words:
    """The words, runs of bytes outside `space`, with 64-bit hashes of their bytes after `lower`.

    Memory is bounded: the bytes are taken in chunks that end between two words.
    """
    hashes, starts, lengths = [], [], []
    row_start = np.zeros(len(data) + 1, dtype=bool)
    row_start[offsets] = True
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not (space[data[end]] or row_start[end]):
            stop = min(n, end + 4096)
            cut = np.flatnonzero(space[data[end:stop]] | row_start[end:stop])
            end = end + int(cut[0]) if len(cut) else stop
        part = data[at:end]
        inside = ~space[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | row_start[at + 1 : end]
        where = np.flatnonzero(inside)
        if len(where):
            first = np.flatnonzero(begins)
            word = np.cumsum(begins[where]) - 1
            value = (lower[part[where]].astype(np.uint64) + np.uint64(1)) * _powers(where - first[word])
            at_first = np.searchsorted(where, first)
            hashes.append(np.add.reduceat(value, at_first))
            starts.append(first + at)
            lengths.append(np.diff(at_first, append=len(where)))
        at = end
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(mix(np.concatenate(hashes)), start, np.concatenate(lengths), np.searchsorted(start, offsets))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (the caller discards runs that cross rows)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h + words[k : len(words) - n + 1 + k]) * _BASE
    return mix(h)
