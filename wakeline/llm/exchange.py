"""Keyed lookups between blocks of documents: what every block holds of a key is put together, and each block gets
its answer, without a row per occurrence and without a table of all keys anywhere.

Documents are dealt into blocks. A block's distinct keys (64-bit), with what it has of each, go to the part that owns
the key; a part puts the blocks' shares together and answers each block in the order of its keys; the block meets its
answers. A hot key comes once from each block, so no part is hot. The three steps are one plan, in which the
exchange of the texts is made once and read by both steps that need it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shuffle_partitions

#: Bytes of text for each partition; there are no fewer partitions than the session's setting.
PARTITION_BYTES = 128 << 20
ASK = "part int, block int, keys binary, shares binary"


def partitions_for(df: DataFrame, text: str = "text") -> int:
    """Partitions, and parts, of an exchange over the texts: by their bytes, so that none grows with the table."""
    n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-n_bytes // PARTITION_BYTES))


def blocks(df: DataFrame, by: Column, n: int, per_partition: int = 2) -> DataFrame:
    """df with a column block, laid out by it in n partitions, each of `per_partition` blocks."""
    return df.withColumn("block", F.pmod(by, F.lit(n * per_partition)).cast("int")).repartition(n, "block")


def parts_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys % np.uint64(n)).astype(np.int64)


def split(keys: np.ndarray, n: int, part_of: Callable = parts_of) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by part (ascending keys within), and where each part begins."""
    part = part_of(keys, n)
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def packed(rows: np.ndarray) -> bytes:
    """Bytes of an array by place: first bytes of all, then second ones. Sorted keys and small counts then compress well."""
    raw = np.ascontiguousarray(rows)
    return np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if len(raw) else b""


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Rows of `width` bytes."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T)


def ask(block: int, keys: np.ndarray, shares: np.ndarray, n: int, part_of: Callable = parts_of) -> pa.Table:
    """Rows of ASK for a block: one for each part that owns one of its keys."""
    order, at = split(keys, n, part_of)
    keys, shares = keys[order].astype("<u8"), np.ascontiguousarray(shares[order])
    has = np.flatnonzero(np.diff(at))
    return pa.table({
        "part": pa.array(has, pa.int32()), "block": pa.array(np.full(len(has), block), pa.int32()),
        "keys": pa.array([packed(keys[at[k] : at[k + 1]]) for k in has], pa.binary()),
        "shares": pa.array([packed(shares[at[k] : at[k + 1]]) for k in has], pa.binary()),
    })


def gathered(table: pa.Table, width: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """What came to a part: its blocks, all keys, all shares, and where each block's begin."""
    table = table.combine_chunks()
    owners = table["block"].to_pylist()
    keys = [unpacked(x.as_py(), 8).view("<u8")[:, 0] for x in table["keys"]]
    shares = [unpacked(x.as_py(), width) for x in table["shares"]]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    return owners, np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(shares) if shares else np.zeros((0, width), np.uint8), at


def replies(part: int, owners: list[int], values: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows (block, part, values) from one value row for each key that came."""
    values = np.ascontiguousarray(values)
    return pa.table({
        "block": pa.array(owners, pa.int32()), "part": pa.array([part] * len(owners), pa.int32()),
        "answer": pa.array([packed(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    })


REPLY = "block int, part int, answer binary"


def answers(keys: np.ndarray, n: int, table: pa.Table, dtype, part_of: Callable = parts_of) -> np.ndarray:
    """The value of each of a block's keys, put back into their order."""
    order, at = split(keys, n, part_of)
    out = np.zeros(len(keys), dtype)
    if len(keys):
        table = table.combine_chunks()
        got = np.zeros(len(keys), dtype)
        for part, x in zip(table["part"].to_pylist(), table["answer"], strict=True):
            got[at[part] : at[part + 1]] = unpacked(x.as_py(), got.itemsize).view(dtype)[:, 0]
        out[order] = got
    return out


def together(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and, for each key that came, its index among them."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], inverse


def lookup(blk: DataFrame, request: Callable, answer: Callable, apply: Callable, schema: str, *, n: int, width: int, dtype, part_of: Callable = parts_of) -> DataFrame:
    """request(table, again) -> keys, shares of a block, and what apply can use (only when asked again, for apply);
    answer(distinct keys, inverse, shares) -> a value for each key that came; apply(keys, values, kept) -> a block's
    result. blk has a column block (see blocks); n: the number of parts."""

    def step1(table: pa.Table) -> pa.Table:
        keys, shares, _ = request(table, False)
        return ask(table["block"][0].as_py(), keys, shares, n, part_of)

    def step2(table: pa.Table) -> pa.Table:
        owners, keys, shares, at = gathered(table, width)
        distinct, inverse = together(keys)
        return replies(table["part"][0].as_py(), owners, answer(distinct, inverse, shares).astype(dtype), at)

    def step3(table: pa.Table, got: pa.Table) -> pa.Table:
        keys, _, kept = request(table, True) if table.num_rows else (np.zeros(0, np.uint64), None, [])
        out = apply(keys, answers(keys, n, got, dtype, part_of), kept)
        release()
        return out

    asked = blk.groupBy("block").applyInArrow(step1, ASK)
    replied = asked.repartition(n, "part").groupBy("part").applyInArrow(step2, REPLY)
    return blk.groupBy("block").cogroup(replied.repartition(n, "block").groupBy("block")).applyInArrow(step3, schema)

