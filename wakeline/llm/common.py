"""What the operators share: the shared folder, Arrow text buffers, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpoint_dir, checkpointed  # noqa: F401  (for the operators)

#: Words are runs of bytes other than these (the contract's `[^\x20\x09-\x0D]+`).
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a kernel works on at once; a longer text is taken whole.
CHUNK_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: survives lost executors, is never recomputed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/wakeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made, once nothing needs it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("wakeline-"):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null as empty) and the offsets of its texts within them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes, one text at least."""
    i = batch.schema.get_field_index(column)
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), np.int64)
    start, total = 0, 0
    for k, x in enumerate(size.tolist()):
        if k > start and total + x > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += x
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives memory that Arrow and the C library hold for later back to the system: a Python worker goes on to other tasks,
    whose needs differ."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_released = [0.0]


def release_now_and_then(seconds: float = 2.0) -> None:
    """release(), for kernels that are called for many small groups: not more often than every so many seconds."""
    if time.monotonic() - _released[0] >= seconds:
        release()
        _released[0] = time.monotonic()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 4096), BASE, np.uint64))
    return _powers


#: Bytes of a segment that are hashed in one sum; the sum is linear in the bytes, so long ones are put together from mixed parts.
LINEAR = 512


def segment_hash(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment: the bytes from its start that are `inside`, up to the next segment's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(data), np.int64)
    at[starts] = starts
    at = np.arange(len(data)) - np.maximum.accumulate(at)
    at[~inside] = 0
    longest = int(at.max())
    within = at if longest < LINEAR else at % LINEAR
    value = powers(min(longest, LINEAR) + 1)[within] * (data.astype(np.uint64) + np.uint64(1))
    value[~inside] = 0
    if longest < LINEAR:
        return mix(np.add.reduceat(value, starts))
    more = np.flatnonzero((within == 0) & (at > 0) & inside)
    part = np.union1d(starts, more)
    sums = mix(np.add.reduceat(value, part))
    head = np.searchsorted(part, starts)
    nth = np.arange(len(part)) - np.repeat(head, np.diff(np.append(head, len(part))))
    sums[nth > 0] = mix(sums[nth > 0] + nth[nth > 0].astype(np.uint64) * BASE)
    total = np.add.reduceat(sums, head)
    return np.where(np.diff(np.append(head, len(part))) > 1, mix(total), sums[head])


class Words:
    """The words of a run of texts: start and end byte, text index and hash of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.inside = ~WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], self.inside[:-1]]) & ~edge[:-1] if len(data) else self.inside
        after = np.concatenate([self.inside[1:], [False]]) & ~edge[1:] if len(data) else self.inside
        self.start = np.flatnonzero(self.inside & ~before)
        self.end = np.flatnonzero(self.inside & ~after) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(at) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = segment_hash(data, self.start, self.inside)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of n words within one text, and the window's hash."""
    if len(words.start) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(words.start) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + words.hash[k : len(words.start) - n + 1 + k]
    i = np.flatnonzero(words.text[: len(h)] == words.text[n - 1 :])
    return i, mix(h[i])


def finite_vectors(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors in double precision) of a list column, for each length: rows that are not null or empty and
    hold no null or non-finite entry. Taken from Arrow's flat buffer."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
    flat = np.asarray(pc.fill_null(col.flatten().cast(pa.float64()), float("nan")), float)
    first = np.concatenate([[0], np.cumsum(size)])
    bad = np.bincount(np.repeat(np.arange(len(size)), size)[~np.isfinite(flat)], minlength=len(size)) > 0
    for d in np.unique(size[(size > 0) & ~bad]).tolist():
        rows = np.flatnonzero((size == d) & ~bad)
        yield d, rows, flat[first[rows][:, None] + np.arange(d)]


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.int64()), 0), np.int64)


def crc_rest(doc_id, m: int):
    """crc32 of the id as text, mod m; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % m
