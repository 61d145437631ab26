"""Training on the cluster, stored models, calibrated thresholds."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import lstm
from wakeline.operators import trajectory as T
from wakeline.plans import sequence


@pytest.fixture(scope="module")
def points(spark):
    """Vessels on smooth tracks, so that there is something to learn."""
    rows = []
    for m in range(12):
        rng = np.random.default_rng(m)
        for k in range(60):
            rows.append((m * 100 + k, m, k * 60, 10 + 0.01 * k + 0.001 * float(rng.normal()), 20 + 0.02 * k, 8 + 4 * float(np.sin(k / 4 + m)) + 0.2 * float(rng.normal()), float((k * 12 + m * 30) % 360), float((k * 12 + m * 30) % 360), 0, int(m == 11 and k > 30)))
    return spark.createDataFrame(rows, "event_id long, mmsi long, t_s long, lat double, lon double, sog double, cog double, heading double, vessel_type int, is_anomaly int").repartition(3)


def arrays_of(data, spark):
    rows = spark.read.parquet(data.path).collect()
    held = np.array([r["scaled"] for r in data.held.collect()])
    return lstm.Arrays(np.array([r["scaled"] for r in rows]), held, np.array([r["batch"] for r in rows]), np.array([r["event_id"] for r in rows]))


@pytest.mark.parametrize("rows_per_task", [10_000, 20])
def test_cluster_and_arrays_come_to_the_same_weights(spark, points, monkeypatch, rows_per_task):
    monkeypatch.setattr(lstm, "FAN_IN", 2)
    data, held, meta = sequence.training_tables(points, batch_size=150, rows_per_task=rows_per_task)
    assert meta["n_val"] == int((meta["n_train"] + meta["n_val"]) * 0.15) and held.count() == meta["n_val"] and data.tasks == -(-150 // rows_per_task)
    near = arrays_of(data, spark)
    assert len(near.a) == meta["n_train"] and near.batches == data.batches and len(data.batches) > 1
    a, b = (lstm.Lstm(8, 6, 2, 5, seed=3) for _ in range(2))
    la, lb = lstm.train(a, data, epochs=2, lr=1e-2), lstm.train(b, near, epochs=2, lr=1e-2)
    assert la["history"] == pytest.approx(lb["history"], rel=1e-9)
    assert all(np.allclose(a.w[k], b.w[k], rtol=0, atol=1e-9) for k in a.w)


def test_dropout_depends_on_the_row_alone():
    keys = np.array([5, -3, 2**62, 0])
    whole = lstm.Draws(keys, 7).random((4, 10, 6))
    assert (lstm.Draws(keys[2:], 7).random((2, 10, 6)) == whole[2:]).all() and (lstm.Draws(keys, 8).random((4, 10, 6)) != whole).all()
    many = lstm.Draws(np.arange(2000), 1).random((2000, 50))
    assert abs(many.mean() - 0.5) < 0.005 and abs((many < 0.1).mean() - 0.1) < 0.005 and abs(np.corrcoef(many[:-1, 0], many[1:, 0])[0, 1]) < 0.1


def test_fit_is_better_than_persistence_and_thresholds_are_held_out_quantiles(spark, points):
    path = sequence.fitted(points, "test", epochs=12, batch_size=64, lr=2e-2, hidden=16, val_frac=0.3)
    model, meta, tables = sequence.load(spark, path)
    assert meta["best_val_loss"] < meta["persistence_loss"] and tables["log"].count() == meta["epochs_run"]
    assert sequence.fitted(points, "test", epochs=12, batch_size=64, lr=2e-2, hidden=16, val_frac=0.3) == path  # not trained again
    _, held, again = sequence.training_tables(points, batch_size=64, val_frac=0.3)
    assert again["mean"] == pytest.approx(meta["mean"])
    errors = T.with_errors(lstm.errors_by(held, model)).select("anomaly_score").toPandas()
    names = {"min": 0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1}
    want = duckdb.sql("select " + ", ".join(f"quantile_cont(anomaly_score, {q}) as {n}" for n, q in names.items()) + ", avg(anomaly_score) as mean, stddev_pop(anomaly_score) as std from errors").df().iloc[0]
    got = {r["name"]: r["value"] for r in tables["thresholds"].collect()}
    assert set(got) == set(want.index) and all(got[n] == pytest.approx(want[n], rel=1e-9) for n in got)


def test_errors_equal_predictions(spark, points):
    seqs = T.sequences(sequence.windows_of(points)).withColumn("scaled", F.col("seq"))
    model = lstm.Lstm(8, 5, 2, 4)
    rows = lstm.errors_by(seqs, model, batch=7).collect()
    a = np.array([r["scaled"] for r in rows])
    assert np.allclose([r["errors"] for r in rows], (model.predict(a[:, :-1]) - a[:, -1]) ** 2)
    assert lstm.errors_by(seqs.limit(0), model).count() == 0


def test_no_sequences(spark, points):
    with pytest.raises(ValueError, match="no sequences"):
        sequence.fit(points.limit(0))


@pytest.mark.parametrize("fan_in", [2, 16])
def test_rounds_of_an_epoch_are_bounded_and_replicas_are_averaged(spark, points, monkeypatch, fan_in):
    """More batches than rounds: the jobs of an epoch stay as many, and the cluster averages as the arrays do."""
    for name, n in (("ROUNDS", 2), ("LOCAL", 3), ("FAN_IN", fan_in)):
        monkeypatch.setattr(lstm, name, n)
    data, _, meta = sequence.training_tables(points, batch_size=25)
    near = arrays_of(data, spark)
    assert len(near.a) == meta["n_train"] and len(data.batches) > 12 and data.replicas == 4
    calls = []
    for name in ("gradient", "replicated"):
        monkeypatch.setattr(data, name, lambda *args, of=getattr(data, name): calls.append(1) or of(*args))
    a, b = (lstm.Lstm(8, 6, 2, 5, seed=3) for _ in range(2))
    la, lb = lstm.train(a, data, epochs=2, lr=1e-2), lstm.train(b, near, epochs=2, lr=1e-2)
    assert len(calls) == 2 * 2
    assert la["history"] == pytest.approx(lb["history"], rel=1e-9) and la["history"][1] < la["history"][0]
    assert all(np.allclose(a.w[k], b.w[k], rtol=0, atol=1e-9) for k in a.w)


def test_one_replica_takes_the_steps_of_single_batches(monkeypatch):
    rng = np.random.default_rng(0)
    data = lstm.Arrays(rng.random((60, 11, 8)), rng.random((10, 11, 8)), np.arange(60) % 4, np.arange(60))
    monkeypatch.setattr(lstm, "ROUNDS", 1)
    a, b = (lstm.Lstm(8, 6, 2, 5, seed=3) for _ in range(2))
    lstm.train(a, data, epochs=1, lr=1e-2)  # a round, a replica, four batches
    adam = lstm.Adam(b.w)
    for k in data.batches:
        adam.step(b, *data.gradient(b, k, adam.steps + 1), 1e-2)
    assert all(np.allclose(a.w[k], b.w[k], rtol=0, atol=1e-12) for k in a.w)
