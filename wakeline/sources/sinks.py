"""Writers: tables, ordered tables, conditional tables, one table per category, JSON, texts, models."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    (df.write.mode("overwrite").csv(path, header=True) if fmt == "csv" else df.write.mode("overwrite").format(fmt).save(path))


def write_if_any(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Writes only a table with rows."""
    if df.isEmpty():
        return False
    write_table(df, path, fmt)
    return True


def write_sorted(df: DataFrame, order: list[Column], path: str, *, rank: str | None = None) -> None:
    """A table in order across its files, read file by file by name: Spark sorts over range partitions, and a file's number is
    its range's. rank: a column for the row's place."""
    out = ranked(df, order, rank) if rank else df
    out.orderBy(*([F.col(rank)] if rank else order)).write.mode("overwrite").parquet(path)


def write_categories_sorted(df: DataFrame, order: list[Column], path: str, categories: str = "category") -> None:
    """One folder per category, each in order across its files."""
    (df.repartitionByRange(F.col(categories), *order).sortWithinPartitions(F.col(categories), *order).write.mode("overwrite").partitionBy(categories).parquet(path))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report or JSON document as one text file below path, through Spark's own file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2, sort_keys=True), path)


def stats_as_json(stats: DataFrame) -> dict:
    """Fleet statistics (a row per feature) as a nested document."""
    return {r["feature"]: {k: r[k] for k in ("p50", "p95", "p99", "p999", "max")} for r in stats.collect()}


def write_model(spark: SparkSession, tables: dict[str, DataFrame], metadata: dict, path: str) -> None:
    """A model's tables as Parquet with its metadata beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(spark, metadata, f"{path}/metadata")


def read_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metadata", wholetext=True).collect()))
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, meta


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
