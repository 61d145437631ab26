"""Expressions on hand-written rows, windows against loops, ranks against pandas, models against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.functions import scalars as S
from wakeline.functions import ranks, stats
from wakeline.operators import events, explain, iforest, lstm, prepare, ranking, rules
from wakeline.operators import trajectory as T
from wakeline.sources import points as P
from wakeline.sources import sinks


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [(350.0, 10.0, 20.0), (0.0, 180.0, -180.0), (10.0, 350.0, -20.0)])
def test_wrap_angle(spark, a, b, want):
    assert one(spark, S.wrap_angle("a", "b"), a=a, b=b) == want


def test_scalars(spark):
    assert one(spark, S.haversine("a", "b", "c", "d"), a=10.0, b=20.0, c=10.5, d=21.0) == pytest.approx(one(spark, S.haversine("a", "b", "c", "d"), c=10.0, d=20.0, a=10.5, b=21.0))
    assert one(spark, S.to_number("a"), a="abc") is None and one(spark, S.to_number("a"), a=" 1 ") == 1.0
    assert one(spark, S.clip("a", 0, 40), a=55.0) == 40
    assert one(spark, S.heading_or_zero("a"), a=511.0) == 0
    assert one(spark, S.implied_mps("a", "b"), a=5.0, b=0.0) is None and one(spark, S.implied_knots_or_zero("a", "b"), a=5.0, b=0.0) == 0
    assert one(spark, S.blank_to_zero("a"), a="") == 0 and one(spark, S.blank_to_zero("a"), a=" ") is None and one(spark, S.blank_only_to_zero("a"), a=" ") == 0
    assert one(spark, S.finite("a"), a=float("nan")) is None
    assert one(spark, S.parse_time("a"), a="2024-12-25 01:02:03") == one(spark, S.parse_time("a"), a=" 2024-12-25T01:02:03 ")
    assert one(spark, S.parse_time("a"), a="yesterday") is None


def reports(spark, vessels):
    rows = [(k * 100 + i, k, int(t), 10.0 + i * 0.01, 20.0 + i * 0.02, float(s), None if i % 3 == 0 else float(i * 40 % 360), 511.0 if i % 4 == 0 else float(i * 7), 0) for k, times in vessels.items() for i, (t, s) in enumerate(times)]
    return spark.createDataFrame(rows, "event_id long, mmsi long, t_s long, lat double, lon double, sog double, cog double, heading double, vessel_type int")


def test_windows_against_loops(spark):
    steady = [(i * 60, i % 50) for i in range(14)]
    exact = [(i * 60 + (3540 if i >= 7 else 0), 5) for i in range(12)]  # one gap of exactly 3600
    broken = [(i * 60 + (3541 if i >= 7 else 0), 5) for i in range(12)]
    short = [(i * 60, 5) for i in range(11)]
    early = [(0, 1)] + [(5000 + i * 60, 5) for i in range(11)]  # the long gap is before the window's first report
    df = reports(spark, {1: steady, 2: exact, 3: broken, 4: short, 5: early})
    v = T.window_validity(T.sequence_features(df))
    got = {r["mmsi"]: r["n"] for r in v.groupBy("mmsi").agg(F.sum(F.col("valid").cast("int")).alias("n")).collect()}
    assert got == {1: 4, 2: 2, 3: 0, 5: 1}
    rows = [np.array(r["seq"]) for r in T.sequences(v).collect()]
    flat = np.concatenate(rows)
    m = {r["feature"]: (r["mean"], r["std"]) for r in T.scaler_moments(T.window_coverage(v)).collect()}
    for k, name in enumerate(T.SEQ_FEATURES):
        std = flat[:, k].std()
        assert m[name] == (pytest.approx(flat[:, k].mean(), abs=1e-9), pytest.approx(std if std >= 1e-8 else 1.0, abs=1e-9))


def test_ranks_and_percentiles(spark):
    x = [1.0, 2.0, 2.0, 3.0]
    df = spark.createDataFrame([(v, "a") for v in x], "v double, c string")
    assert sorted(r["p"] for r in ranks.with_percent_rank(df, "v", ["c"], "p").collect()) == sorted((pd.Series(x).rank(pct=True) * 100).round(2))
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])
    big = spark.createDataFrame([(float(a),) for a in v], "v double")
    for limit in (10**6, 400):
        got = list(stats.percentiles(big, ["v"], [0.0, 0.5, 0.95, 1.0], limit).first())[1:]
        assert got == pytest.approx(list(np.quantile(v, [0.0, 0.5, 0.95, 1.0])))
    assert (ranking.top_size(101, 0.01, "ceil"), ranking.top_size(101, 0.01, "floor"), ranking.top_size(1, 0.01, "floor")) == (2, 1, 1)
    with pytest.raises(ValueError):
        ranking.top_size(10, 1.5, "ceil")
    ids = spark.range(500).withColumn("s", (F.col("id") * 7919) % 1000)
    r = ranking.ranked(ids, [F.desc("s"), F.col("id")]).toPandas().sort_values("rank")
    assert r["rank"].tolist() == list(range(1, 501)) and r["s"].is_monotonic_decreasing
    s = ranking.train_val_split(ids, 0.15, 42, "id")
    assert s.where("is_val").count() == 75


def test_prepare(spark):
    df = spark.createDataFrame([(1, 0, 1, "1", 5.0, 1.0, None), (1, 1, 2, "abc", 7.0, 1.0, None), (2, 0, 5, "4", None, 1.0, None)], "mmsi long, t_prev long, t_curr long, a string, dist_m double, c double, n double")
    out, scaler = prepare.prepare_features(df)
    assert scaler["features"] == ["a", "dist_m"] and scaler["dropped"] == ["c", "n"]
    a = np.array([1, 2.5, 4.0])
    assert sorted(r["a"] for r in out.collect()) == pytest.approx(list((a - a.mean()) / a.std(ddof=1)))
    with pytest.raises(ValueError):
        prepare.prepare_features(df.select("mmsi", "t_prev", "t_curr", "c"))


def test_explain(spark):
    top = spark.createDataFrame([(None, 1, 2, 0.9), (5, 1, 2, 0.8)], "mmsi long, t_prev long, t_curr long, anomaly_score double")
    feats = spark.createDataFrame([(None, 1, 2, 10.0, 5.0), (5, 1, 2, 3.0, 0.0), (5, 1, 2, 4.0, 2.0)], "mmsi long, t_prev long, t_curr long, dist_m double, delta_t_s double")
    out = explain.explain_table(top, feats, [F.desc("anomaly_score"), F.col("dist_m")]).collect()
    assert list(out[0].asDict())[:6] == ["mmsi", "t_prev", "t_curr", "anomaly_score", "anomaly_rank", "anomaly_rank_pct"]
    assert [r["anomaly_rank"] for r in out] == [1, 2, 3] and out[0]["dist_m"] == 10.0 and out[1]["implied_mps"] is None
    with pytest.raises(ValueError):
        explain.explain_join(top.drop("mmsi"), feats)


def test_rules(spark):
    df = spark.createDataFrame([(10.0, 1.0), (10.1, 500.0), (None, None)], "sog_curr double, delta_t_s double")
    out = rules.classify(df, {"sog_curr": 10.0, "delta_t_s": 100.0})
    assert [(r["categories"], r["n_categories"]) for r in out.collect()] == [("unclassified", 0), ("speed,timegap", 2), ("unclassified", 0)]
    assert [(r["category"], r["n"]) for r in rules.category_summary(out).collect()] == [("speed", 1), ("turn", 0), ("timegap", 1), ("distance", 0), ("unclassified", 2)]
    assert rules.category_summary(out.limit(0)).count() == 5
    zero = rules.classify(df, {"sog_curr": 0.0}).select("cat_score_speed").first()[0]
    assert zero == pytest.approx(1e10)


def test_fixed_tables():
    assert rules.RULES == {"speed": ("sog_curr", "abs_dsog"), "turn": ("abs_dcog",), "timegap": ("delta_t_s",), "distance": ("dist_m", "implied_kts")}
    assert T.ERR_GROUPS == {"speed": (0,), "course": (1, 2), "heading": (3, 4), "position_jump": (5, 6), "time_gap": (7,)}
    assert explain.FRONT[:7] == ["mmsi", "t_prev", "t_curr", "anomaly_score", "decision_function", "anomaly_rank", "anomaly_rank_pct"] and explain.FRONT[-1] == "vessel_type"


def test_rule_speed(spark):
    """An implied speed alone is a distance, never a speed."""
    df = spark.createDataFrame([(1.0, 0.0, 99.0)], "sog_curr double, abs_dsog double, implied_kts double")
    limits = {"sog_curr": 10.0, "abs_dsog": 10.0, "implied_kts": 20.0}
    assert rules.classify(df, limits).first()["categories"] == "distance"
    rows = {r["category"]: r for r in rules.summary_table(rules.classify(df, limits), limits, "p99").collect()}
    assert rows["distance"]["thresholds"] == "dist_m > inf, implied_kts > 20.00" and rows["distance"]["n_anomalies"] == 1 and rows["unclassified"]["thresholds"] == "-"
    assert rows["speed"]["threshold_level"] == "p99" and rows["speed"]["rule_description"].endswith("fleet p99)")


def test_events(spark):
    p = reports(spark, {1: [(i * 60, 5) for i in range(5)]})
    ev = spark.createDataFrame([(7, 1, 60, 120, "top", 1.0), (8, 9, 60, 120, "top", 0.5)], "key long, mmsi long, t_prev long, t_curr long, sample_kind string, score double")
    got = {r["key"]: (r["status"], r["n_context"]) for r in events.manifest(ev, p, "speed").collect()}
    assert got == {7: ("saved", 5), 8: ("skipped (not enough context points)", 0)}
    assert {r["status"] for r in events.manifest(ev, p, "timegap").collect()} == {"saved"}


def test_forest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 2)), [[9.0, 9.0], [-8.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    nodes, meta = iforest.fit(df, ["a", "b"], ["id"], n_trees=40)
    got = iforest.score(df, nodes, meta).toPandas().sort_values("anomaly_score", ascending=False)
    assert set(got["id"].head(2)) == {400, 401} and got["anomaly_score"].between(0, 1).all()
    again, _ = iforest.fit(df.repartition(3), ["a", "b"], ["id"], n_trees=40)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    assert iforest.mean_path(2) == 1 and iforest.mean_path(256) == pytest.approx(2 * (math.log(255) + iforest.EULER) - 2 * 255 / 256)
    for bad in ("0", "1.5", "0.0"):
        with pytest.raises(ValueError):
            iforest.parse_max_samples(bad, 100)
    with pytest.raises(ValueError):
        iforest.parse_contamination("0.7")


def test_lstm(spark):
    m = lstm.Lstm(8, 64, 2)
    assert m.n_parameters() == 54_568
    small = lstm.Lstm(3, 4, 2, 5, dropout=0.0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 4, 3)), rng.normal(size=(6, 3))
    out, cache = small.forward(x)
    g = small.backward(2 * (out - y) / out.size, cache)
    for name in small.w:
        w = small.w[name]
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), w.shape)
        kept, e = w[at], 1e-6
        w[at] = kept + e
        up = np.mean((small.forward(x)[0] - y) ** 2)
        w[at] = kept - e
        down = np.mean((small.forward(x)[0] - y) ** 2)
        w[at] = kept
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-5, abs=1e-9)
    a = np.concatenate([x, y[:, None]], 1)
    log = lstm.train(small, lstm.Arrays(a, a, np.arange(6) % 2, np.arange(6)), epochs=30, lr=1e-2)
    assert log["best_val_loss"] < log["history"][0]
    df = spark.createDataFrame([(x[k].tolist(),) for k in range(3)], "scaled array<array<double>>")
    got = np.array([r["errors"] for r in lstm.errors_by(df, small).collect()])
    assert got == pytest.approx((small.predict(x[:3, :-1]) - x[:3, -1]) ** 2)
    assert np.array([r["errors"] for r in lstm.errors_by_persistence(df).collect()]) == pytest.approx((x[:3, -2] - x[:3, -1]) ** 2)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading\n1,2024-12-25T00:00:00,1.0,2.0,,3.0,511\nx,2024-12-25T00:00:00,1,2,3,4,5\n2,bad,1,2,3,4,5\n3,2024-12-25 00:00:01,abc,2,3,4,5\n")
    got = P.typed_points(P.raw_csv(spark, f"file://{tmp_path}/p.csv")).collect()
    assert len(got) == 1 and got[0]["mmsi"] == 1 and got[0]["sog"] == 0
    s = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0)], "feature string, p50 double, p95 double, p99 double, p999 double, max double")
    sinks.write_json(spark, sinks.stats_as_json(s), f"file://{tmp_path}/s")
    assert P.fleet_stats_json(spark, f"file://{tmp_path}/s").collect() == s.collect()
    assert P.fleet_stats_json(spark, f"file://{tmp_path}/none").count() == 0
    assert not sinks.write_if_any(s.limit(0), f"file://{tmp_path}/n") and sinks.write_if_any(s, f"file://{tmp_path}/y")


def test_stream_equals_batch(spark, tmp_path):
    from wakeline.streaming import classify as live

    df = reports(spark, {k: [(i * 60 + k, i) for i in range(6)] for k in range(3)})
    cols = ["mmsi", "t_s", "event_id", "lat", "lon", "sog", "cog"]
    for part in (0, 1):
        df.where((F.col("t_s") < 180) == F.lit(part == 0)).select(cols).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.select(cols).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.classified(stream, {"sog_curr": 3.0}).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == 15
    assert {tuple(r) for r in spark.table("live").select("event_id", "dist_m", "cat_speed").collect()} == {tuple(r) for r in rules.classify(T.transitions(df), {"sog_curr": 3.0}).select("event_id", "dist_m", "cat_speed").collect()}


def test_commands(spark, tmp_path):
    """Both methods through their commands, on CSV files with times as texts."""
    from wakeline import cli

    rng = np.random.default_rng(3)
    t = lambda s: str(pd.Timestamp("2024-12-25") + pd.Timedelta(seconds=int(s)))
    pts = pd.DataFrame([(m, t(i * 120), 10 + i * 0.01, 20 + rng.normal() * 0.01, abs(rng.normal() * 8), i * 17 % 360, 511) for m in range(1, 7) for i in range(30)], columns=["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading"])
    pts.to_csv(tmp_path / "points.csv", index=False)
    n = 150
    feats = pd.DataFrame({"MMSI": np.arange(n) % 6 + 1, "t_prev": [t(i * 120) for i in np.arange(n) % 25], "t_curr": [t(i * 120 + 120) for i in np.arange(n) % 25], "delta_t_s": 120.0, "dist_m": rng.gamma(2, 500, n), "dsog": rng.normal(size=n), "dcog": rng.normal(size=n) * 20, "dheading": rng.normal(size=n), "sog_curr": rng.gamma(2, 4, n), "vessel_type": 1})
    feats.to_csv(tmp_path / "features.csv", index=False)
    p = lambda name: f"file://{tmp_path}/{name}"

    def run(*args):
        a = cli.parser().parse_args([str(x) for x in args])
        a.run(spark, a)

    run("prepare", "--input", p("features.csv"), "--output-dir", p("prep"))
    run("forest", "--x", p("prep/features"), "--model-out", p("model"), "--scores-out", p("scores"), "--top-out", p("top"), "--summary-out", p("sum"), "--n-estimators", 10, "--top-frac", 0.2)
    assert spark.read.parquet(p("top")).count() == 30 and "train_seconds" in "".join(r[0] for r in spark.read.text(p("sum")).collect())
    score = [r["anomaly_score"] for r in spark.read.parquet(p("scores")).collect()]
    report = "\n".join(r[0] for r in spark.read.text(p("sum")).collect())
    assert len(score) == n and all(x in report for x in ("written: 20", "n_samples: 150", "top_count: 30", "n_trees: 10", "random_state", "p99: 0."))
    run("explain", "--top", p("top"), "--features", p("features.csv"), "--out", p("explain"))
    table = spark.read.parquet(p("explain"))
    assert table.columns[:4] == ["mmsi", "t_prev", "t_curr", "anomaly_score"] and table.where("dist_m is not null").count() >= 30
    run("fleet-stats", "--features", p("explain"), "--out", p("fleet"))
    run("classify", "--explain", p("explain"), "--ref-stats", p("fleet"), "--out-dir", p("cls"), "--threshold", "p50")
    assert spark.read.parquet(p("cls/summary")).columns == ["category", "n_anomalies", "pct_of_if_total", "threshold_level", "thresholds", "rule_description", "assignment"]
    report = "\n".join(r[0] for r in spark.read.text(p("cls/report")).collect())
    assert all(x in report for x in ("threshold level: p50", "speed: sog_curr > ", "unclassified: ", "more than one: ", "reference statistics: file:"))
    run("events", "--classified-dir", p("cls"), "--points", p("points.csv"), "--out-dir", p("figs"), "--n-top", 2, "--n-random", 2)
    m = spark.read.parquet(p("figs/speed/manifest")).collect()
    assert m and {r["status"] for r in m} == {"saved"} and all(r["category_score"] > 0 for r in m)
    run("fit-sequences", "--input", p("points.csv"), "--output-dir", p("lstm"), "--epochs", 2, "--hidden", 8)
    run("score-sequences", "--input", p("points.csv"), "--model-dir", p("lstm"), "--output-dir", p("seq"), "--top-frac", 0.1, "--batch-size", 64)
    top = spark.read.parquet(p("seq/top"))
    report = "\n".join(r[0] for r in spark.read.text(p("seq/report")).collect())
    assert all(x in report for x in ("vessels scored: 6", "sequences: 120", "top count: 12", "Thresholds on held-out", "p99: ", "position_jump: "))
    assert spark.read.parquet(p("figs/speed/marks")).where("peak is not null").count() > 0
    assert top.columns[0] == "rank" and top.count() == int(6 * 20 * 0.1)
    top.withColumns({c: F.timestamp_seconds(c).cast("string") for c in ("t_prev", "t_curr")}).toPandas().to_csv(tmp_path / "top.csv", index=False)
    run("sequence-events", "--top", p("top.csv"), "--points", p("points.csv"), "--out-dir", p("sfigs"), "--n-top", 2, "--n-random", 2)
    assert spark.read.parquet(p("sfigs/sequence/manifest")).where("status = 'saved'").count() > 0


def test_half_turns_are_minus_180(spark):
    """Whatever the last bit of the difference: in the query and in its SQL."""
    import duckdb

    from wakeline.plans import registry

    tenths = [(a / 10.0, (a + 1800) % 3600 / 10.0) for a in range(3600)] + [(10.0, 20.0), (350.0, 10.0), (0.0, 179.9999), (None, 1.0)]
    df = spark.createDataFrame(tenths, "a double, b double").select("a", "b", S.turn("a", "b").alias("t"))
    got = [r["t"] for r in df.collect()]
    assert got == [-180.0] * 3600 + [10.0, 20.0, 179.9999, None]
    rows = ", ".join(f"({'null' if a is None else repr(a) + 'e0'}::double, {b!r}e0)" for a, b in tenths)
    assert [r[0] for r in duckdb.sql(f"select {registry.sql_turn('a', 'b')} from (values {rows}) x(a, b)").fetchall()] == got


def test_scaler_does_not_depend_on_the_order_of_rows(spark):
    """Mean and deviation are the same to the last bit however the rows are dealt, and those of exact sums."""
    rng = np.random.default_rng(5)
    n = 40_001
    data = {"wide": np.round(rng.pareto(1.5, n) * 1e4, 3), "far": 1.7e9 + np.round(rng.normal(size=n), 6), "small": rng.normal(size=n) * 1e-12, "gaps": np.where(rng.random(n) < 0.1, np.nan, rng.integers(-1800, 1800, n) / 10)}
    df = spark.createDataFrame(pd.DataFrame({"mmsi": np.arange(n), "t_prev": 0, "t_curr": 1} | data)).replace(float("nan"), None)
    scalers = [prepare.prepare_features(x, log_dist=False)[1] for x in (df.coalesce(1), df.repartition(3), df.repartition(11, "wide"), df.orderBy(F.desc("small")))]
    assert all(s["mean"] == scalers[0]["mean"] and s["std"] == scalers[0]["std"] for s in scalers)
    for c, v in data.items():
        v = np.where(np.isnan(v), np.nanmedian(v), v)
        mean = math.fsum(v) / n
        std = math.sqrt(math.fsum((v - mean) ** 2) / (n - 1))
        assert abs(scalers[0]["mean"][c] - mean) <= 1e-12 * std + 1e-15 * abs(mean) and scalers[0]["std"][c] == pytest.approx(std, rel=1e-12)
    one = df.limit(1).withColumns({"wide": F.lit(2.5)})
    assert prepare.moments(one.select("wide"), {"wide": 2.5}) == ({"wide": 2.5}, {"wide": None})
