"""The sequence method: features, windows, scaler, prediction errors, top list."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import descending_position, error_stats
from ..operators import trajectory as T
from ..operators.lstm import Lstm, OnCluster, dealing, errors_by, errors_by_persistence, train
from ..operators.ranking import sample_rows, sample_vessels, top_fraction, train_val_split
from ..sources import sinks
from ..sources.shared import shared_path, stored


def windows_of(points: DataFrame, seq_len: int = 10) -> DataFrame:
    return T.window_validity(T.sequence_features(points, seq_len), seq_len)


def scaler(validity: DataFrame, seq_len: int = 10) -> tuple[list[float], list[float]]:
    rows = T.scaler_moments(T.window_coverage(validity, seq_len)).orderBy("place").collect()
    return [r["mean"] or 0.0 for r in rows], [r["std"] or 1.0 for r in rows]


def score(points: DataFrame, mean: list[float], std: list[float], model: Lstm | None = None, seq_len: int = 10, batch: int = 2048) -> DataFrame:
    """A row per valid window with anomaly_score and err_*; model None: persistence."""
    seqs = T.sequences(windows_of(points, seq_len), seq_len, last=None if model else 2)  # persistence looks at the last two
    seqs = seqs.withColumn("scaled", T.scaled(F.col("seq"), mean, std)).drop("seq")
    found = errors_by(seqs, model, batch=batch) if model else errors_by_persistence(seqs)
    return T.with_errors(found).drop("scaled", "errors")


def top(scores: DataFrame, fraction: float = 0.01) -> DataFrame:
    """The top table: floor of the fraction, rank, percentile_rank among all scored, dominant error and its reason."""
    rows, n = top_fraction(scores, [F.desc("anomaly_score"), F.col("mmsi"), F.col("event_id")], fraction, "floor")
    label, reason = T.dominant_error()
    rows = rows.withColumn("percentile_rank", descending_position("rank", n)).withColumn("dominant_error", label).withColumn("reason_text", reason)
    return rows.select("rank", *(c for c in rows.columns if c != "rank"))


def training_tables(points: DataFrame, *, seq_len: int = 10, batch_size: int = 512, max_vessels: int = 2000, val_frac: float = 0.15, seed: int = 42, max_sequences: int | None = None, rows_per_task: int = 8192) -> tuple[OnCluster, DataFrame, dict]:
    """The trainer's view of the normal sequences of sampled vessels, the validation table, and metadata. Labels are filtered
    before differences are taken. max_sequences: only so many of them, by hash order."""
    spark = points.sparkSession
    normal = points.where("is_anomaly = 0") if "is_anomaly" in points.columns else points
    normal = normal.join(sample_vessels(normal, max_vessels, seed), "mmsi", "left_semi")
    validity = windows_of(normal, seq_len)
    mean, std = scaler(validity, seq_len)
    seqs = T.sequences(validity, seq_len).withColumn("scaled", T.scaled(F.col("seq"), mean, std)).select("event_id", "scaled")
    if max_sequences is not None:
        seqs = sample_rows(seqs, max_sequences, seed, "event_id")
    seqs, _ = stored(seqs)
    split = train_val_split(seqs, val_frac, seed, "event_id")
    held, _ = stored(split.where("is_val").select("event_id", "scaled"))
    n_val, n = held.count(), seqs.count()
    if not n:
        raise ValueError("no sequences")
    n_batches, tasks = max(1, -(-(n - n_val) // batch_size)), -(-batch_size // rows_per_task)
    rounds, replicas = dealing(n_batches)
    h = F.xxhash64(F.lit(seed + 1), "event_id")
    dealt = split.where("not is_val").select("event_id", "scaled", F.pmod(h, F.lit(n_batches)).alias("batch"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(tasks)).alias("slot"))
    dealt = dealt.withColumn("round", F.col("batch") % rounds).withColumn("replica", F.floor(F.col("batch") / rounds) % replicas)
    train_rows, path = stored(dealt.repartition("round", "replica", "slot").drop("slot"), "round")
    batches = sorted(r["batch"] for r in train_rows.select("batch").distinct().collect())  # a number for each step of an epoch
    meta = {"mean": mean, "std": std, "seq_len": seq_len, "batch_size": batch_size, "max_vessels": max_vessels, "val_frac": val_frac, "n_train": n - n_val, "n_val": n_val, "features": list(T.SEQ_FEATURES)}
    return OnCluster(spark, path, batches, held if n_val else train_rows.select("event_id", "scaled"), tasks, replicas), held, meta


def fit(points: DataFrame, *, seq_len: int = 10, hidden: int = 64, layers: int = 2, epochs: int = 30, batch_size: int = 512, lr: float = 1e-3, max_vessels: int = 2000, val_frac: float = 0.15, patience: int = 5, seed: int = 42, max_sequences: int | None = None) -> tuple[Lstm, dict]:
    """Trains on the cluster, and takes thresholds from the held-out sequences' errors (exact percentiles of all of them)."""
    data, held, meta = training_tables(points, seq_len=seq_len, batch_size=batch_size, max_vessels=max_vessels, val_frac=val_frac, seed=seed, max_sequences=max_sequences)
    model = Lstm(len(meta["mean"]), hidden, layers, seed=seed)
    log = train(model, data, epochs=epochs, lr=lr, patience=patience, seed=seed)
    persisted = T.with_errors(errors_by_persistence(data.held)).agg(F.avg("anomaly_score")).first()[0]
    limits = stats(T.with_errors(errors_by(held, model))).first().asDict()
    return model, meta | {"hidden": hidden, "layers": layers, "lr": lr, "seed": seed, "thresholds": limits, "persistence_loss": persisted, **log}


#: Version of the layout of stored models.
MODEL_VERSION = 2


def model_tables(spark: SparkSession, model: Lstm, meta: dict) -> dict[str, DataFrame]:
    """A model as tables: weights, scaler, thresholds (on held-out errors) and the training log."""
    weights = [(k, list(v.shape), v.ravel().tolist()) for k, v in model.w.items()]
    scales = [(k, f, m, s) for k, (f, m, s) in enumerate(zip(meta["features"], meta["mean"], meta["std"], strict=True))]
    limits = [(k, None if v is None else float(v)) for k, v in meta["thresholds"].items()]
    log = [(k + 1, float(v), float(r), k + 1 == meta["best_epoch"]) for k, (v, r) in enumerate(zip(meta["history"], meta["rates"], strict=True))]
    return {
        "weights": spark.createDataFrame(weights, "name string, shape array<int>, w array<double>"), "scaler": spark.createDataFrame(scales, "place int, feature string, mean double, std double"),
        "thresholds": spark.createDataFrame(limits, "name string, value double"), "log": spark.createDataFrame(log, "epoch int, val_loss double, learning_rate double, best boolean"),
    }


def save(spark: SparkSession, model: Lstm, meta: dict, path: str) -> None:
    kept = {k: v for k, v in meta.items() if k not in ("history", "rates")}
    sinks.write_model(spark, model_tables(spark, model, meta), kept | {"model_version": MODEL_VERSION}, path)


def load(spark: SparkSession, path: str) -> tuple[Lstm, dict, dict[str, DataFrame]]:
    """The model, its metadata and its tables, as save() wrote them."""
    tables, meta = sinks.read_model(spark, path, ["weights", "scaler", "thresholds", "log"])
    if meta.get("model_version") != MODEL_VERSION:
        raise ValueError(f"the model at {path} has another version")
    scales = tables["scaler"].orderBy("place").collect()  # a row for each feature
    model = Lstm(len(scales), meta["hidden"], meta["layers"])
    model.w = {r["name"]: np.array(r["w"]).reshape(r["shape"]) for r in tables["weights"].collect()}
    return model, meta | {"mean": [r["mean"] for r in scales], "std": [r["std"] for r in scales]}, tables


def fitted(points: DataFrame, name: str, **parameters) -> str:
    """Path of a stored model of these reports; trained and written where the shared folder has none of that version, input
    files and parameters."""
    spark = points.sparkSession
    told = json.dumps([MODEL_VERSION, name, sorted(points.inputFiles()), points.count(), parameters], sort_keys=True)
    path = shared_path(spark, f"wakeline-model-{hashlib.sha256(told.encode()).hexdigest()[:24]}")
    if not sinks.exists(spark, f"{path}/metadata/_SUCCESS"):  # the metadata are written last
        save(spark, *fit(points, **parameters), path)
    return path


def stats(scores: DataFrame) -> DataFrame:
    return error_stats(scores, "anomaly_score")
