"""Ranks within groups of any size: distinct values with their counts, range partitions, and running sums over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Keys that hold this share of the rows and more are joined by broadcast (1 / HOT_SHARE of them at most).
HOT_SHARE = 0.001


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, upto (rows of the group with this value or a smaller one) and total, for each distinct value.

    The distinct values are sorted over range partitions, so a group of all rows is as many tasks as the table; sums of whole
    partitions (a row for each partition and group in it) are added up first.
    """
    distinct = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = checkpointed(distinct.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "part").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("part").alias("part_"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("all").over(Window.partitionBy(*keys)).alias("total"))
    same = [parts[k].eqNullSafe(totals[f"{k}_"]) for k in keys]
    joined = parts.join(totals, [parts["part"] == totals["part_"], *same])
    within = F.sum("n").over(Window.partitionBy("part", *keys).orderBy(value))
    return joined.select(*keys, value, "n", (F.col("before") + within).alias("upto"), "total")


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], add: list[str], share: float = HOT_SHARE) -> DataFrame:
    """df with the columns `add` of counted, which has a row for each combination of the keys in df, and its number of rows n.

    Combinations so frequent that 1 / share of them at most can be are joined by broadcast; of the others, none is large
    enough to make one task of the shuffle long. Rows already answered get a key of their own there.
    """
    counted = checkpointed(counted)
    rows = counted.agg(F.sum("n")).first()[0] or 0
    least = max(2, share * rows)
    key = lambda: F.struct(*keys)
    hot = counted.where(F.col("n") >= least).select(key().alias("__k1"), F.struct(*add).alias("__hot"))
    rest = counted.where(F.col("n") < least).select(key().alias("__k2"), F.lit(None).cast("long").alias("__o2"), F.struct(*add).alias("__rest"))
    near = df.join(F.broadcast(hot), key().eqNullSafe(F.col("__k1")), "left")
    own = F.when(F.col("__hot").isNotNull(), F.monotonically_increasing_id())
    near = near.withColumn("__own", own).withColumn("__k", F.when(F.col("__hot").isNull(), key()))
    both = near.join(rest, F.col("__k").eqNullSafe(F.col("__k2")) & F.col("__own").eqNullSafe(F.col("__o2")), "left")
    chosen = F.coalesce("__hot", "__rest")
    return both.select(*df.columns, *(chosen[c].alias(c) for c in add))


def with_percent_rank(df: DataFrame, value: str, keys: list[str], name: str = "percentile_rank") -> DataFrame:
    """df with 100 * average rank / rows of the group, ascending, ties averaged, half-even to 2 places."""
    counts = running_counts(df, keys, value)
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    counts = counts.withColumn(name, F.bround(100.0 * rank / F.col("total"), 2))
    return join_counted(df, counts, [*keys, value], [name])
