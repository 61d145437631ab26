"""Operators on the path that large tables take: low limits, hot keys, heavy ties."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.functions import quantiles, ranks
from wakeline.operators import chunks, events, explain, rules
from wakeline.operators import trajectory as T


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Jobs:
    """Counts the jobs that a block runs."""

    def __init__(self, spark):
        self.tracker, self.context, self.group = spark.sparkContext.statusTracker(), spark.sparkContext, f"jobs-{uuid.uuid4().hex}"

    def __enter__(self):
        self.context.setJobGroup(self.group, "counted")
        return self

    def __exit__(self, *_):
        self.count = len(self.tracker.getJobIdsForGroup(self.group))
        self.context._jsc.clearJobGroup()


QS = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]


def test_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(1)
    n = 6000
    data = {
        "normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "mostly": np.where(rng.random(n) < 0.9, 0.25, rng.normal(size=n)), "same": np.full(n, 3.0), "steps": np.round(rng.pareto(1.1, n), 1), "long": rng.integers(-(10**12), 10**12, n).astype(float), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
    }
    df = spark.createDataFrame(pd.DataFrame(data)).replace(float("nan"), None).withColumn("nothing", F.lit(None).cast("double")).repartition(5)
    names = [*data, "nothing"]
    for limit, accuracy in ((10**6, 10_000), (300, 100), (40, 100), (2500, 1000)):
        with Jobs(spark) as jobs:
            got = {r["feature"]: list(r)[1:] for r in quantiles.percentiles(df, names, QS, limit, accuracy).collect()}
        assert got.pop("nothing") == [None] * len(QS)
        for c, v in got.items():
            assert v == pytest.approx(list(np.quantile(data[c][~np.isnan(data[c])], QS)), rel=1e-12), (limit, c)
        assert jobs.count <= (30 if accuracy == 100 else 15), (limit, jobs.count)  # adaptive execution runs a stage of a pass as a job


def test_quantile_passes_do_not_grow_with_the_columns(spark):
    df = spark.range(20_000).select(*(F.pmod(F.xxhash64(F.lit(k), "id"), 10_000 * (k + 1)).cast("double").alias(f"c{k}") for k in range(9)))
    counts = []
    for names in (["c0"], [f"c{k}" for k in range(9)]):
        with Jobs(spark) as jobs:
            quantiles.percentiles(df, names, [0.5, 0.95, 0.99, 0.999, 1.0], 2000, 1000)
        counts.append(jobs.count)
    assert counts[0] >= counts[1] - 1 and max(counts) <= 10


def test_order_statistics_with_nan_last(spark):
    df = spark.createDataFrame([(float(k),) for k in range(50)] + [(float("nan"),)] * 50 + [(float("inf"),)] * 3, "v double")
    got = quantiles.order_statistics(df, {"v": [0, 49, 50, 52, 53, 102]}, {"v": 103}, in_one_task=5, accuracy=50)
    assert [got["v", k] for k in (0, 49, 50, 52)] == [0, 49, float("inf"), float("inf")] and all(got["v", k] != got["v", k] for k in (53, 102))


def test_percent_rank_of_hot_groups_and_ties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(4000), "c": ["hot"] * 3900 + ["small"] * 99 + ["one"], "v": np.where(rng.random(4000) < 0.4, 0.0, rng.integers(0, 500, 4000) / 7)})
    df = spark.createDataFrame(pdf).repartition(6)
    pdf["want"] = (pdf.groupby("c")["v"].rank(pct=True) * 100).round(2)
    for share in (0.001, 0.05, 2.0):
        counts = ranks.running_counts(df, ["c"], "v").withColumn("p", F.bround(100.0 * (F.col("upto") - (F.col("n") - 1) / 2.0) / F.col("total"), 2))
        got = ranks.join_counted(df, counts, ["c", "v"], ["p"], share).toPandas().sort_values("id")
        assert len(got) == 4000 and np.allclose(got["p"].to_numpy(), pdf["want"].to_numpy(), atol=0.0051)
    assert ranks.with_percent_rank(df.limit(0), "v", ["c"]).count() == 0
    nulls = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "a", 5.0)], "id int, c string, v double")
    assert {r["id"]: r["percentile_rank"] for r in ranks.with_percent_rank(nulls, "v", ["c"]).collect()} == {1: 50.0, 2: 100.0, 3: 100.0}


def test_category_rows_have_no_window_over_the_category(spark):
    df = spark.range(3000).selectExpr("id as event_id", "cast(id % 400 as double) as sog_curr", "0.0 as abs_dsog", "0.0 as abs_dcog", "0.0 as delta_t_s", "0.0 as dist_m", "0.0 as implied_kts")
    out = rules.category_rows(rules.classify(df, {"sog_curr": 10.0}))
    assert "Window" not in re.sub(r"Window \[[^\]]*\], \[part[^\]]*", "", plan_of(out))
    assert out.groupBy("category").count().collect()[0]["count"] == sum(k % 400 > 10 for k in range(3000))
    assert out.agg(F.max("percentile_rank")).first()[0] < 100 and out.where("sog_curr = 399").first()["percentile_rank"] == out.agg(F.max("percentile_rank")).first()[0]


def test_rules_take_nan_and_text_as_nothing(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (float("inf"), "12"), (50.0, None), (1.0, "nan")], "sog_curr double, abs_dsog string").withColumn("abs_dcog", F.lit("200").cast("string"))
    got = rules.classify(df, {"sog_curr": 10.0, "abs_dsog": 5.0, "abs_dcog": 90.0, "dist_m": 3.0}).select("cat_speed", "cat_score_speed", "cat_turn", "cat_distance").collect()
    assert [tuple(r) for r in got] == [(False, 0.0, True, False), (True, 2.4, True, False), (True, 5.0, True, False), (False, 0.1, True, False)]


def ship_reports(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for mmsi, n in sizes.items():
        t = np.cumsum(rng.choice([0, 1, 60, 300, 4000], n, p=[0.1, 0.2, 0.4, 0.28, 0.02]))
        rows += [(len(rows) + k, mmsi, int(t[k]), float(rng.normal()), float(rng.normal()), float(rng.integers(0, 50)), None if k % 9 == 0 else float(rng.integers(0, 360)), 511.0 if k % 7 == 0 else float(rng.integers(0, 360)), 0) for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, mmsi long, t_s long, lat double, lon double, sog double, cog double, heading double, vessel_type int").repartition(5)


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hot_rows", [400, 60, 7])
def test_large_vessels_are_several_tasks_with_the_same_result(spark, monkeypatch, hot_rows):
    points = ship_reports(spark, {1: 1500, 2: 59, 3: 5, 4: 61})
    steps = {
        "pairs": lambda: T.transitions(points), "features": lambda: T.core(T.sequence_features(points)), "coverage": lambda: T.window_coverage(T.window_validity(T.sequence_features(points))),
        "sequences": lambda: T.sequences(T.window_validity(T.sequence_features(points))),
    }
    whole = {k: as_rows(f()) for k, f in steps.items()}
    monkeypatch.setattr(chunks, "HOT_ROWS", hot_rows)
    cut = chunks.split(points, 11, 10)
    sizes = {(r["mmsi"], r[chunks.CHUNK]): r["count"] for r in cut.groupBy("mmsi", chunks.CHUNK).count().collect()}
    assert sum(m == 1 for m, _ in sizes) >= min(100, 1500 // hot_rows) and sum(m == 3 for m, _ in sizes) == 1
    assert max(sizes.values()) <= 2 * hot_rows + 21 + 12
    for k, f in steps.items():
        assert as_rows(f()) == whole[k], k


def test_one_vessel_of_all_rows_and_one_time(spark, monkeypatch):
    monkeypatch.setattr(chunks, "HOT_ROWS", 20)
    same = spark.range(200).selectExpr("id as event_id", "7L as mmsi", "5L as t_s", "0.1 * id as lat", "0.0 as lon", "1.0 as sog", "10.0 as cog", "20.0 as heading", "0 as vessel_type")
    assert T.transitions(same).count() == 199 and T.sequences(T.window_validity(T.sequence_features(same))).count() == 190
    assert T.transitions(same.limit(0)).count() == 0
    nobody = same.withColumn("mmsi", F.lit(None).cast("long")).withColumn("t_s", F.col("event_id"))
    assert T.transitions(nobody).count() == 199


@pytest.mark.parametrize("limit", [10**6, 0])
def test_interval_join(spark, monkeypatch, limit):
    monkeypatch.setattr(events, "BROADCAST_ROWS", limit)
    points = ship_reports(spark, {1: 400, 2: 30}).where("not (mmsi = 1 and t_s between 20000 and 40000)")
    p = points.collect()
    ev = [(0, 1, 5000, 5100), (1, 1, 10_000, 90_000), (2, 2, -200_000, 400_000), (3, 1, 28_000, 28_100), (4, 9, 0, 10), (5, 2, None, 50), (6, 1, 9000, 1000), (7, 1, 3600, 3600), (7, 1, 3600, 3600)]
    df = spark.createDataFrame(ev, "key long, mmsi long, t_prev long, t_curr long")
    out = events.context(df, points)
    want = []
    for e in ev:
        near = [r for r in p if e[2] is not None and r["mmsi"] == e[1] and e[2] - 3600 <= r["t_s"] <= e[3] + 3600]
        want += [(*e, r["t_s"], r["event_id"]) for r in near] or [(*e, None, None)]
    assert sorted(map(str, out.select("key", "mmsi", "t_prev", "t_curr", "p_t", "p_id").collect())) == sorted(f"Row(key={a}, mmsi={b}, t_prev={c}, t_curr={d}, p_t={t}, p_id={i})" for a, b, c, d, t, i in want)
    assert sum(w[0] == 3 and w[4] is None for w in want) == 1 and sum(w[0] == 2 for w in want) > 25
    assert events.context(df.limit(0), points).count() == 0 and events.context(df, points.limit(0)).count() == len(ev)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_explain_join_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(explain, "BROADCAST_ROWS", limit)
    top = spark.createDataFrame([(1, 2, "a"), (None, 2, "b"), (5, 5, "c"), (1, 2, "d")], "mmsi long, t_curr long, x string")
    features = spark.createDataFrame([(1, 2, 1.0, "p"), (1, 2, 2.0, "q"), (None, 2, 3.0, "r"), (8, 8, 4.0, "s")], "mmsi long, t_curr long, v double, x string")
    got = explain.explain_join(top, features, ("mmsi", "t_curr")).collect()
    assert sorted((r["x"], r["v"] or 0, r["x_feat"] or "", r["matched"]) for r in got) == [("a", 1.0, "p", True), ("a", 2.0, "q", True), ("b", 3.0, "r", True), ("c", 0, "", False), ("d", 1.0, "p", True), ("d", 2.0, "q", True)]


def files_in_order(spark, path):
    """Rows file by file, files by name."""
    names = sorted(r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect())
    return len(names), [r for n in names for r in spark.read.parquet(n).collect()]


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordered_tables_read_back_in_order(spark, tmp_path, partitions):
    from wakeline.sources import sinks

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).selectExpr("id as event_id", "pmod(xxhash64(id), 400) / 10 as score", "case when id % 3 = 0 then 'a' else 'b' end as category").repartition(5)
        order = [F.desc("score"), F.col("event_id")]
        sinks.write_sorted(df, order, f"file://{tmp_path}/all", rank="rank")
        n, rows = files_in_order(spark, f"file://{tmp_path}/all")
        assert n == partitions and [r["rank"] for r in rows] == list(range(1, 2001)) and [(-r["score"], r["event_id"]) for r in rows] == sorted((-r["score"], r["event_id"]) for r in rows)
        sinks.write_categories_sorted(df, order, f"file://{tmp_path}/cat")
        for c, want in (("a", 667), ("b", 1333)):
            n, rows = files_in_order(spark, f"file://{tmp_path}/cat/category={c}")
            assert len(rows) == want and [(-r["score"], r["event_id"]) for r in rows] == sorted((-r["score"], r["event_id"]) for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_strict_times_and_clock(spark):
    from wakeline.functions import scalars as S

    df = spark.createDataFrame([("2024-12-25 10:00:30",), (None,)], "t string")
    assert [r[0] for r in df.select(S.strict_epoch("t")).collect()] == [1735120830.0, None]
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        spark.createDataFrame([("2024-12-25T10:00:30",)], "t string").select(S.strict_epoch("t")).collect()
    got = spark.createDataFrame([(1735120830, 1735121031)], "a long, b long").select(S.midpoint("a", "b").alias("m"), S.clock("a").alias("h"), S.clock(S.midpoint("a", "b")).alias("k")).first()
    assert tuple(got) == (1735120930.5, "10:00", "10:02")


def test_table_function_equals_the_windows(spark):
    from wakeline.operators import vessel_udtf
    from wakeline.plans import sequence

    points = ship_reports(spark, {1: 300, 2: 12, 3: 11, 4: 3}).withColumn("sog", F.when(F.col("event_id") % 50 != 49, F.col("sog"))).withColumn("t_s", F.col("t_s").cast("double"))
    mean, std = [0.1 * k for k in range(8)], [1.0 + k for k in range(8)]
    vessel_udtf.register(spark)
    points.createOrReplaceTempView("ship_reports")
    told = ", ".join("array(" + ", ".join(f"{x!r}D" for x in v) + ")" for v in (mean, std))
    got = spark.sql(f"select * from score_vessel(table(ship_reports) partition by mmsi order by (t_s, event_id), {told})").toPandas().sort_values("event_id").reset_index(drop=True)
    want = sequence.score(points, mean, std).toPandas().sort_values("event_id").reset_index(drop=True)
    assert len(got) == len(want) > 100 and set(got["mmsi"]) == {1, 2} and got["anomaly_score"].isna().any()
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, equal_nan=True), c


def test_a_split_and_a_sample_send_no_task_all_rows(spark, monkeypatch):
    """Neither a heap of the wanted rows nor a sort: the k-th hash comes from counts of bins; repeated keys as well."""
    from wakeline.operators import ranking

    monkeypatch.setattr(ranking, "HEAP_ROWS", 10)
    monkeypatch.setattr(ranking, "ranked", lambda *_: pytest.fail("sorted"))
    ids = spark.range(3000).repartition(5)
    order = [r["id"] for r in ids.orderBy(ranking.hash_order(42, "id"), "id").collect()]
    for fraction in (0.15, 0.0004, 0.999):
        split = ranking.train_val_split(ids, fraction, 42, "id")
        assert {r["id"] for r in split.where("is_val").collect()} == set(order[: int(3000 * fraction)]) and split.count() == 3000
    for n in (1500, 2999, 3000, 5000):
        got = ranking.sample_rows(ids, n, 42, "id")
        assert sorted(r["id"] for r in got.collect()) == sorted(order[:n])
    twice = ids.unionByName(ids)
    got = [r["id"] for r in ranking.sample_rows(twice, 301, 42, "id").collect()]
    assert sorted(got) == sorted([*order[:150], *order[:150], order[150]])


def test_statistics_work_a_column_out_once(spark):
    from wakeline.functions import stats

    for f in (stats.error_stats, stats.score_summary, lambda df, c: stats.fleet_stats(df, [c])):
        calls = spark.sparkContext.accumulator(0)

        def value(x, calls=calls):
            calls.add(1)
            return float(x)

        assert f(spark.range(500).select(F.udf(value, "double")("id").alias("v")), "v").first()["p95"] == pytest.approx(474.05)
        assert calls.value == 500
