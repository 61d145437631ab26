"""Streams with late reports give what the batch gives."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import trajectory as T
from wakeline.streaming import ordered

COLUMNS = ["mmsi", "t_s", "event_id", "lat", "lon", "sog", "cog"]
SCHEMA = "mmsi long, t_s long, event_id long, lat double, lon double, sog double, cog double"


def run(spark, folder, parts, name, limits, **settings):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/{name}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/{name}")
    q = ordered.write_live(stream, limits, f"file://{folder}/{name}-out", f"file://{folder}/{name}-ck", **settings)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"file://{folder}/{name}-out/transitions"), spark.read.parquet(f"file://{folder}/{name}-out/late")


def test_shuffled_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for m in (1, 2):
        t = np.cumsum(rng.choice([5, 40, 200, 4000], 60, p=[0.3, 0.4, 0.25, 0.05]))
        rows += [(m, int(x), m * 100 + k, 10 + 0.01 * k, 20 + float(rng.normal()) * 0.01, float(rng.integers(0, 20)), None if k % 5 == 0 else float(k * 31 % 360)) for k, x in enumerate(t)]
    end = max(r[1] for r in rows)
    shuffled = sorted(rows, key=lambda r: r[1] + float(rng.uniform(0, 290)))  # 290 seconds late at most
    last = [(m, end + 100_000, m * 100 + 99, 1.0, 1.0, 1.0, 1.0) for m in (1, 2)]  # pushes out what waits
    parts = [*np.array_split(np.array(shuffled, dtype=object), 4), last]
    got, late = run(spark, tmp_path, [[tuple(r) for r in p] for p in parts], "in", {"sog_curr": 10.0}, lateness=300, idle=0)
    assert late.count() == 0
    points = spark.createDataFrame(rows, SCHEMA).withColumns({"heading": F.lit(511.0), "vessel_type": F.lit(0)})
    want = T.transitions(points)
    same = ["mmsi", "event_id", "t_prev", "t_curr", "delta_t_s", "dist_m", "dsog", "dcog", "sog_curr"]
    assert sorted(map(str, got.where("event_id % 100 <> 99").select(same).collect())) == sorted(map(str, want.select(same).collect()))
    valid = {r["event_id"] for r in T.window_validity(T.sequence_features(points)).where("valid").collect()}
    assert {r["event_id"] for r in got.where("run > 10").collect()} == valid and valid


def test_older_reports_are_told_apart_and_counted(spark, tmp_path):
    row = lambda t, e: (1, t, e, 1.0 + e, 2.0, 3.0, 4.0)
    got, late = run(spark, tmp_path, [[row(0, 1), row(100, 2), row(1000, 3)], [row(50, 4), row(950, 5)], [row(5000, 6)], [row(5000, 6), row(999, 7)]], "late", {}, lateness=300, idle=0)
    assert sorted((r["t_s"], r["event_id"]) for r in late.collect()) == [(50, 4), (999, 7)]
    assert sorted((r["t_prev"], r["t_curr"]) for r in got.collect()) == [(0, 100), (100, 950), (950, 1000)]


def test_idle_vessels_leave_and_are_forgotten(spark, tmp_path):
    import time

    spark.createDataFrame([(1, 0, 1, 1.0, 2.0, 3.0, 4.0), (1, 60, 2, 1.0, 2.0, 3.0, 4.0)], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/idle")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/idle")
    q = ordered.write_live(stream, {}, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", lateness=300, idle=1.0)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(f"{tmp_path}/out/transitions") and spark.read.schema("event_id long").parquet(f"file://{tmp_path}/out/transitions").count():
                break
    finally:
        q.stop()
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/transitions").select("t_prev", "t_curr").collect()] == [(0, 60)]
