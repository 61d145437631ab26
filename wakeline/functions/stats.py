"""Summaries of features, scores and errors: exact quantiles, moments and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .quantiles import percentiles


def fleet_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, p50, p95, p99, p999, max: the reference statistics that rules and figures look thresholds up in."""
    names = ("p50", "p95", "p99", "p999", "max")
    out = percentiles(stored(df.select(*columns))[0], columns, (0.5, 0.95, 0.99, 0.999, 1.0))
    return out.select("feature", *(F.col(f"p{k}").alias(n) for k, n in enumerate(names)))


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """Seven quantiles, mean and sample deviation (0 for one row) of a score, which is worked out once, whatever the passes."""
    df, _ = stored(df.select(column))
    q = percentiles(df, [column], (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0)).drop("feature")
    q = q.toDF("min", "p01", "p05", "p50", "p95", "p99", "max")
    m = df.agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"))
    return q.crossJoin(F.broadcast(m))  # one row by one row


def error_stats(df: DataFrame, column: str) -> DataFrame:
    """Eight quantiles, mean and population deviation of an error, which is worked out once, whatever the passes."""
    df, _ = stored(df.select(column))
    q = percentiles(df, [column], (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)).drop("feature")
    q = q.toDF("min", "p25", "p50", "p75", "p90", "p95", "p99", "max")
    m = df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return q.crossJoin(F.broadcast(m))  # one row by one row


def descending_position(rank: str | Column, n: int | Column) -> Column:
    """100 * (1 - (rank - 1) / n), half-even to 4 places: the top row is 100."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    n = n if isinstance(n, Column) else F.lit(n)
    return F.bround(100.0 * (1 - (rank - 1) / n), 4)
