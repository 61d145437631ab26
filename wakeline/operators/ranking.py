"""Sorts, top fractions, ranks and seeded samples. Every order has a total tie-break; every random choice is a hash order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, stored

#: Up to so many rows a top list is kept by Spark's heap, whose last task gets as many from each task; beyond, rows are ranked
#: over range partitions, or cut by their hash's bins.
HEAP_ROWS = 20_000
#: First hex digits of a hash that tell its bin.
BIN_DIGITS = 4


def top_size(n: int, fraction: float, rule: str) -> int:
    """max(1, ceil or floor of n * fraction); fraction must be in (0, 1) for ceil."""
    if rule == "ceil" and not 0 < fraction < 1:
        raise ValueError("top_frac must be in (0, 1)")
    return max(1, (math.ceil if rule == "ceil" else math.floor)(n * fraction))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A global row number without one task that sees all rows: range partitions, their counts, and places within."""
    parts = checkpointed(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", 33)
    sizes = sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "p long, before long")
    out = parts.withColumn("p", part).join(F.broadcast(offsets), "p")
    return out.withColumn(name, F.col("before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("p", "before", "__id")


def top_rows(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows with their rank."""
    if k <= HEAP_ROWS:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows
    return ranked(stored(df)[0], order, name).where(F.col(name) <= k)


def top_fraction(df: DataFrame, order: list[Column], fraction: float, rule: str, name: str = "rank") -> tuple[DataFrame, int]:
    """The top fraction with its rank, and the number of all rows."""
    n = df.count()
    return top_rows(df, order, top_size(n, fraction, rule), name), n


def hash_order(seed: int, *keys: str) -> Column:
    """md5 of the seed and the keys, with colons between: an order that any engine can make again."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """min(n, rows) rows without replacement, always the same."""
    if n <= HEAP_ROWS:
        return df.orderBy(hash_order(seed, *keys), *keys).limit(n)
    bins = hash_bins(df, seed, *keys)
    if sum(bins.values()) <= n:
        return df
    place, last, before = hash_cut(df, bins, n, seed, *keys)
    return df.where(place < last).unionByName(df.where(place == last).limit(n - before))  # rows of one key


def hash_bins(df: DataFrame, seed: int, *keys: str) -> dict[str, int]:
    """Rows by the first digits of their hash: 16 ** BIN_DIGITS numbers at most."""
    counted = df.groupBy(F.substring(hash_order(seed, *keys), 1, BIN_DIGITS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return {r["bin"]: r["n"] for r in counted.collect()}


def hash_cut(df: DataFrame, bins: dict[str, int], k: int, seed: int, *keys: str) -> tuple[Column, Column, int]:
    """A row's place in hash order, the k-th row's, and the rows before that place. Only the bin that holds the k-th row is
    sorted, by its distinct keys."""
    before = 0
    for bin_, n in sorted(bins.items()):
        if before + n >= k:
            break
        before += n
    h = hash_order(seed, *keys)
    own = df.select(h.alias("h"), *keys).where(F.substring("h", 1, BIN_DIGITS) == bin_).groupBy("h", *keys).agg(F.count(F.lit(1)).alias("n"))
    upto = own.withColumn("upto", F.sum("n").over(Window.partitionBy(F.substring("h", 1, BIN_DIGITS)).orderBy("h", *keys)))
    last = upto.where(F.col("upto") >= k - before).agg(F.min(F.struct("h", *keys, "upto", "n")).alias("x")).first()["x"]
    return F.struct(h.alias("h"), *keys), F.struct(F.lit(last["h"]).alias("h"), *(F.lit(last[c]).alias(c) for c in keys)), before + last["upto"] - last["n"]


def sample_vessels(points: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n of all vessels (not only of those in a file's first rows)."""
    return sample_rows(points.select("mmsi").distinct(), n, seed, "mmsi")


def train_val_split(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """is_val for exactly floor(n * fraction) rows: those up to the n_val-th hash. Two aggregates and no global sort."""
    bins = hash_bins(df, seed, *keys)
    n_val = int(sum(bins.values()) * fraction)
    if n_val == 0:
        return df.withColumn("is_val", F.lit(False))
    place, last, _ = hash_cut(df, bins, n_val, seed, *keys)
    return df.withColumn("is_val", place <= last)


def first_per_vessel(df: DataFrame, order: list[Column]) -> DataFrame:
    """Each vessel's first row in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("mmsi").orderBy(*order))).where("__r = 1").drop("__r")
