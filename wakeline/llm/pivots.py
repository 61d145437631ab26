"""Embedding near-dedup: a pivot-permutation index.

A vector is described by its DEPTH nearest reference points (pivots), in order. Its inverted lists are those of the rarest
of them: as two descriptions with `shared` pivots in common must have one in their rarest DEPTH - shared + 1, every
such pair meets in a list. In a list the shared pivots are counted, and the pairs with enough of them are verified by
their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, written
from .graph import components, join_pairs

DEPTH, SHARED = 10, 3
#: Vectors per pivot aimed at, and bounds of the number of pivots (what is broadcast: MOST_PIVOTS vectors at most).
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 200, 64, 4096
#: A longer list is cut into blocks, which meet in pairs.
BLOCK = 2048


def vectors_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable: not null, not zero, without null or non-finite
    components. All rows are of one length (the caller takes the lengths in turn)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = np.zeros(len(col), bool)
    lists = col.to_pylist()
    width = max((len(x) for x in lists if x), default=0)
    out = np.zeros((len(col), width))
    for k, x in enumerate(lists):
        if x and len(x) == width and None not in x:
            out[k] = x
            rows[k] = True
    with np.errstate(all="ignore"):
        biggest = np.abs(out).max(axis=1, initial=0)
        rows &= np.isfinite(biggest) & (biggest > 0)
        out[~rows] = 0
        out /= np.where(rows, biggest, 1)[:, None]
        out /= np.where(rows, np.sqrt((out * out).sum(1)), 1)[:, None]
    return out, rows


def _unit_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit, ok = vectors_of(batch.column(1))
        rows = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([unit[k].tobytes() for k in rows], pa.binary())], ["vec_id", "unit"])


def choose(sample: np.ndarray, m: int, apart: float = 0.7) -> np.ndarray:
    """m pivots: vectors of the sample that are not close to one chosen before (a crowd of near copies gives one), then
    seeded random directions."""
    chosen = np.zeros((m, sample.shape[1]))
    n = 0
    for x in sample:
        if n < m and (n == 0 or (chosen[:n] @ x).max() < apart):
            chosen[n] = x
            n += 1
    rest = np.random.Generator(np.random.PCG64(7)).standard_normal((m - n, sample.shape[1]))
    chosen[n:] = rest / np.sqrt((rest * rest).sum(1))[:, None]
    return chosen


def describe(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Ordered nearest pivots of each vector (ties: the lower pivot)."""
    depth = min(DEPTH, len(pivots))
    near = unit @ pivots.T
    top = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    order = np.lexsort((top, -np.take_along_axis(near, top, 1)))
    return np.take_along_axis(top, order, 1).astype(np.int32)


def _stack(col) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), np.float64).reshape(len(col), -1)


def _posting_kernel(pivots_of, rank_of, splits_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rank, splits = pivots_of.value, rank_of.value, splits_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _stack(batch.column(2))
            near = describe(unit, pivots)
            ranks = np.sort(rank[near], axis=1)  # rarest first
            lists = ranks[:, : max(1, ranks.shape[1] - SHARED + 1)]
            cid = np.asarray(batch.column(0), np.int64)
            own = (mix(cid.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            row, key, lo, hi, first = [], [], [], [], []
            for k in range(lists.shape[1]):
                s = splits[lists[:, k]]
                for r in range(int(s.max())):
                    live = np.flatnonzero(s > r)
                    mine = own[live] % s[live]
                    row.append(live)
                    key.append(lists[live, k])
                    lo.append(np.minimum(mine, r))
                    hi.append(np.maximum(mine, r))
                    first.append(mine <= r)
            row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key)), pa.array(np.concatenate(lo), pa.int32()), pa.array(np.concatenate(hi), pa.int32()), pa.array(np.concatenate(first)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array([ranks[k].astype("<i4").tobytes() for k in row], pa.binary())],
                ["list", "lo", "hi", "first", "cid", "copies", "unit", "ranks"],
            )

    return run


def _list_kernel(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        own = table["list"][0].as_py()
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        cid, copies = np.asarray(table["cid"], np.int64), np.asarray(table["copies"], np.int64)
        unit = _stack(table["unit"])
        ranks = np.frombuffer(b"".join(x.as_py() for x in table["ranks"]), "<i4").reshape(len(cid), -1)
        side = np.asarray(table["first"].to_numpy(), bool)
        left = np.arange(len(cid)) if same else np.flatnonzero(side)
        right = np.arange(len(cid)) if same else np.flatnonzero(~side)
        here, column = np.unique(ranks, return_inverse=True)
        marks = np.zeros((len(cid), len(here)), np.float32)
        np.put_along_axis(marks, column.reshape(ranks.shape), 1, 1)
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        within = max(1, ranks.shape[1] - SHARED + 1)
        need = min(SHARED, ranks.shape[1])
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            i, j = np.nonzero(marks[rows] @ marks[right].T >= need)
            i, j = rows[i], right[j]
            keep = cid[i] < cid[j] if same else cid[i] != cid[j]
            i, j = i[keep], j[keep]
            for b in range(0, len(i), 1 << 16):
                x, y = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[near], y[near]
                # a pair that meets in several lists counts in the one of its rarest common pivot
                both = (ranks[x][:, :within, None] == ranks[y][:, None, :within]).any(2)
                lead = np.where(both, ranks[x][:, :within], np.iinfo(np.int32).max).min(1) == own
                x, y = x[lead], y[lead]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                join_pairs(root, x, y)
        hit = np.flatnonzero(links)
        # one row per vector, with the root of its set: every link of the list stays reachable
        return pa.table({"cid": cid[hit], "links": links[hit], "other": cid[root[hit]]})

    return run


def linked(df: DataFrame, *, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing (component: themselves).
    Vectors of different lengths never link. Equal directions are one class with a number of copies, so copies
    are not expanded into pairs. Ids are taken as the vectors' names: rows that share one get one answer, that of one of their
    vectors; rows without an id link with nothing. An empty table gives no rows; other columns are ignored.
    """
    each = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.size(embedding).alias("w")).where("e is not null and w > 0 and vec_id is not null")
    spark = df.sparkSession
    widths = [r[0] for r in each.select("w").distinct().orderBy("w").collect()]  # lengths of vectors: a handful
    found, own = [], []
    for w in widths:
        units = each.where(F.col("w") == w).select("vec_id", "e").mapInArrow(_unit_kernel, "vec_id long, unit binary")
        units = written(units)
        own.append(units)
        distinct = written(units.groupBy("unit").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).select("cid", "copies", "unit"))
        n = distinct.count()
        if not n:
            continue
        m = pivots_for(n)
        sample = distinct.select("unit").orderBy(F.xxhash64(F.lit(3), "unit"), "unit").limit(2 * m).collect()  # a bounded sample
        pivots = choose(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.float64).reshape(len(sample), -1), m)
        pivots_of = spark.sparkContext.broadcast(pivots)

        def uses(batches: Iterator[pa.RecordBatch], pivots_of=pivots_of) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(pivots_of.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount(describe(_stack(batch.column(0)), pivots_of.value).ravel(), minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pivot", "n"])

        use = np.zeros(len(pivots), np.int64)
        for r in distinct.select("unit").mapInArrow(uses, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():  # a row per pivot
            use[r["pivot"]] = r["n"]
        rank = np.empty(len(use), np.int64)
        rank[np.argsort(use, kind="stable")] = np.arange(len(use))
        splits = np.empty(len(use), np.int64)
        splits[rank] = np.maximum(1, -(-use // BLOCK))
        postings = distinct.mapInArrow(_posting_kernel(pivots_of, spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(splits)), "list long, lo int, hi int, first boolean, cid long, copies long, unit binary, ranks binary")
        found.append(postings.groupBy("list", "lo", "hi").applyInArrow(_list_kernel(threshold), "cid long, links long, other long"))
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"))
    if not found:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    hits = written(hits)
    links = hits.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(hits.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    members = own[0].withColumn("w", F.lit(widths[0]))
    for w, x in zip(widths[1:], own[1:], strict=True):
        members = members.unionByName(x.withColumn("w", F.lit(w)))
    key = members.groupBy("unit").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    members = members.select("vec_id", "unit").join(key, "unit").select(F.col("vec_id").alias("mid"), "cid", "copies").dropDuplicates(["mid"])
    out = base.join(members, F.col("vec_id") == F.col("mid"), "left").join(links.withColumnRenamed("cid", "lcid"), F.col("cid") == F.col("lcid"), "left").join(comp, F.col("cid") == F.col("node"), "left")
    component = F.coalesce("component", "cid", "vec_id")
    n_links = F.coalesce(F.col("links"), F.lit(0).cast("long")) + F.coalesce(F.col("copies") - 1, F.lit(0).cast("long"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def pivots_for(n: int) -> int:
    return min(max(LEAST_PIVOTS, math.ceil(n / PER_PIVOT)), MOST_PIVOTS)
