"""Readers of position reports, statistics and models. Schemas are declared, never inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

POINT_SCHEMA = "MMSI string, BaseDateTime string, LAT string, LON string, SOG string, COG string, Heading string"
LABELLED_SCHEMA = POINT_SCHEMA + ", is_anomaly string"


def raw_csv(spark: SparkSession, path: str, *, labelled: bool = False) -> DataFrame:
    """All columns as texts, as a CSV file with a header has them. Malformed UTF-8 becomes U+FFFD."""
    return spark.read.schema(LABELLED_SCHEMA if labelled else POINT_SCHEMA).csv(path, header=True, enforceSchema=False)


def typed_points(raw: DataFrame) -> DataFrame:
    """mmsi, ts, t_s, lat, lon, sog, cog, heading[, is_anomaly]; rows without a time, vessel, place or speed are rejected."""
    cols = [
        F.trim("MMSI").try_cast("long").alias("mmsi"), S.parse_time("BaseDateTime").alias("ts"), S.to_number("LAT").alias("lat"), S.to_number("LON").alias("lon"),
        S.blank_to_zero("SOG").alias("sog"), (S.to_number("COG") if "COG" in raw.columns else F.lit(None).cast("double")).alias("cog"), (S.to_number("Heading") if "Heading" in raw.columns else F.lit(None).cast("double")).alias("heading"),
    ]
    if "is_anomaly" in raw.columns:
        cols.append(S.to_number("is_anomaly").cast("int").alias("is_anomaly"))
    out = raw.select(*cols).where("mmsi is not null and ts is not null and lat is not null and lon is not null and sog is not null")
    return out.withColumn("t_s", F.unix_micros("ts") / 1e6)


def strict_points(raw: DataFrame) -> DataFrame:
    """For figures: course counts too, blank courses are 0."""
    bad_course = S.blank_only_to_zero("COG")
    return typed_points(raw).drop("cog") if "COG" not in raw.columns else typed_points(raw.where(bad_course.isNotNull()).withColumn("COG", bad_course.cast("string")))


def lenient_points(raw: DataFrame) -> DataFrame:
    """For the sequence figures: no course."""
    return typed_points(raw).drop("cog", "heading")


def clean_events(events: DataFrame) -> DataFrame:
    """The driver's events as position reports: a real minute is a second. All numbers come from integer arithmetic."""
    k = F.get_json_object("props", "$.k").cast("long")
    e, u = F.col("event_id"), F.col("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", u.alias("mmsi"), F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("t_s"),
        (F.lit(25) + u % 20 + (e * 7919 % 1000) / 10000.0).alias("lat"), (F.lit(-90) + u % 30 + (e * 104729 % 1000) / 10000.0).alias("lon"),
        (F.col("value") / 10).alias("sog"), F.when(e % 50 == 0, None).otherwise(((k * 73 + e * 17) % 3600) / 10.0).alias("cog"),
        F.when(k % 10 == 0, 511).otherwise(k * 37 % 360).cast("double").alias("heading"), (F.col("event_type") == "error").cast("int").alias("is_anomaly"), (u % 5).cast("int").alias("vessel_type"),
    ).where(micros.isNotNull())


def vessels_of(points: DataFrame, vessels: DataFrame) -> DataFrame:
    """The reports of a set of vessels. Spark broadcasts the set when it is small enough."""
    return points.join(vessels.select("mmsi").distinct(), "mmsi", "left_semi")


def fleet_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON of feature -> {statistic: value} as rows feature, p50, p95, p99, p999, max. A missing file is an empty table."""
    schema = "map<string, struct<p50:double, p95:double, p99:double, p999:double, max:double>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001  only a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "feature string, p50 double, p95 double, p99 double, p999 double, max double")
    return text.select(F.explode(F.from_json("value", schema)).alias("feature", "s")).select("feature", "s.*")


def json_artifact(spark: SparkSession, path: str) -> dict:
    """A small JSON document (scaler, thresholds, configuration)."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
