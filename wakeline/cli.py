"""Command line: prepare, forest, explain, classify, events, fit-sequences, score-sequences, sequence-events.

Inputs and outputs are Parquet (or CSV with a header where a path ends in .csv) on any file system Spark reads.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, stats
from .operators import events, explain, iforest, prepare, ranking, reports, rules, trajectory
from .plans import method_a, sequence
from .shipping import ship
from .sources import points, sinks
from .sources.shared import checkpointed


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table; the columns of a CSV are texts, but for those that tables of this program hold as numbers."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    df = spark.read.csv(path, header=True)
    texts = {"t_prev", "t_curr", "t_start", "categories", "category", "dominant_error", "reason_text", "basedatetime"}
    return df.select(*(F.col(c) if c.lower() in texts or c.startswith("cat_") and not c.startswith("cat_score") else F.col(c).try_cast("long" if c.lower() in ("mmsi", "rank", "anomaly_rank", "n_categories", "vessel_type") else "double").alias(c) for c in df.columns))


def reports_of(spark: SparkSession, path: str) -> DataFrame:
    """Typed position reports with an order key."""
    df = points.typed_points(points.raw_csv(spark, path)) if path.endswith(".csv") else read(spark, path)
    return df if "event_id" in df.columns else df.withColumn("event_id", F.xxhash64(*df.columns))


def keyed(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() if c.lower() == "mmsi" else c for c in df.columns))


def prepare_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    out, scaler = prepare.prepare_features(keyed(read(spark, a.input)), log_dist=not a.no_log_dist)
    sinks.write_table(out, f"{a.output_dir}/features")
    sinks.write_json(spark, scaler, f"{a.output_dir}/scaler")


def forest_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    ship(spark)
    share = iforest.parse_contamination(a.contamination)
    x = keyed(read(spark, a.x))
    keys = [c for c in prepare.META if c in x.columns]
    x, names, cleaned = prepare.training_table(x, [c for c in x.columns if c not in prepare.META], keys)
    began = time.perf_counter()
    nodes, meta = iforest.fit(x, names, keys, n_trees=a.n_estimators, max_samples=a.max_samples, seed=a.random_state)
    nodes = checkpointed(nodes)
    meta |= cleaned | {"train_seconds": round(time.perf_counter() - began, 6), "top_frac": a.top_frac, "contamination": a.contamination, "random_state": a.random_state}
    scored = iforest.score(x, nodes, meta)
    if share is not None:
        meta["offset"] = -stats.percentiles(scored, ["anomaly_score"], [1 - share]).first()["p0"]
        scored = scored.withColumn("decision_function", -F.col("anomaly_score") - meta["offset"])
    scored = scored.select(*keys, "anomaly_score", "decision_function")
    order = [F.desc("anomaly_score"), *map(F.col, keys)]
    top, n = ranking.top_fraction(scored, order, a.top_frac, "ceil")
    sinks.write_model(spark, {"nodes": nodes}, meta, a.model_out)
    sinks.write_sorted(scored, order, a.scores_out)
    sinks.write_sorted(top.drop("rank"), order, a.top_out)
    files = {"x": a.x, "model": a.model_out, "scores": a.scores_out, "top": a.top_out}
    sinks.write_text(spark, reports.forest_report(meta | {"n_rows": n}, stats.score_summary(scored, "anomaly_score"), ranking.top_size(n, a.top_frac, "ceil"), files), a.summary_out)


def explain_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    top, features = keyed(read(spark, a.top)), keyed(read(spark, a.features))
    order = [F.desc("anomaly_score"), *map(F.col, prepare.META)]
    sinks.write_table(explain.explain_table(top, features, order, top_n=a.top_n), a.out)


def classify_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    fleet = points.fleet_stats_json(spark, a.ref_stats)
    limits = rules.thresholds(fleet, a.threshold)
    out = rules.classify(keyed(read(spark, a.explain)), limits)
    sinks.write_table(out, f"{a.out_dir}/classified")
    by_score = [F.desc("category_score"), *(F.col(c) for c in prepare.META if c in out.columns)]
    sinks.write_categories_sorted(rules.category_rows(out), by_score, f"{a.out_dir}/by_category")
    sinks.write_if_any(out.where("n_categories = 0"), f"{a.out_dir}/unclassified")
    sinks.write_table(rules.summary_table(out, limits, a.threshold), f"{a.out_dir}/summary")
    sinks.write_json(spark, sinks.stats_as_json(fleet), f"{a.out_dir}/reference_stats")
    sinks.write_text(spark, reports.category_report(out, limits, a.threshold, {"explain table": a.explain, "reference statistics": a.ref_stats, "output": a.out_dir}), f"{a.out_dir}/report")


def events_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = keyed(read(spark, f"{a.classified_dir}/by_category"))
    p = reports_of(spark, a.points)
    for kind in rules.RULES:
        own = rows.where(F.col("category") == kind)
        if own.isEmpty():
            continue
        write_events(spark, own, p, kind, a)


#: What a figure draws along the context, and the marks on it: a table for each event.
FIGURE_CONTEXT = {"turn": events.pairwise_turn, "distance": events.pairwise_distance}
FIGURE_MARKS = {
    "speed": lambda ctx, ev: events.peak(ctx, "p_sog"),
    "turn": lambda ctx, ev: events.peak(events.pairwise_turn(ctx), "abs_turn"),
    "timegap": lambda ctx, ev: events.time_marks(ev).select("key", "mid_s", "from_hm", "mid_hm", "to_hm", "minutes"),
    "distance": lambda ctx, ev: events.with_jump_km(events.jump_ends(ctx)),
    "sequence": lambda ctx, ev: events.time_marks(ev).select("key", "mid_s", "from_hm", "mid_hm", "to_hm", "minutes"),
}


def write_events(spark: SparkSession, rows: DataFrame, p: DataFrame, kind: str, a: argparse.Namespace) -> None:
    picked = events.sample_events(rows, a.n_top, a.n_random, a.random_seed, *prepare.META)
    score = "category_score" if "category_score" in picked.columns else "anomaly_score"
    # times of tables are texts, timestamps or numbers; the reports' are seconds
    picked = picked.withColumns({c: scalars.epoch_seconds(picked, c) for c in ("t_prev", "t_curr")})
    picked = picked.withColumns({"key": F.xxhash64(*prepare.META), "score": F.col(score)})
    seconds = getattr(a, "context_s", 3600)
    ctx = events.segments(events.context(picked.select("key", *prepare.META), p, seconds))
    ctx = checkpointed(events.enough(ctx, kind))
    sinks.write_table(FIGURE_CONTEXT.get(kind, lambda x: x)(ctx), f"{a.out_dir}/{kind}/context")
    sinks.write_table(FIGURE_MARKS[kind](ctx, picked), f"{a.out_dir}/{kind}/marks")
    sinks.write_table(events.manifest(picked, p, kind, seconds), f"{a.out_dir}/{kind}/manifest")


def fit_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    ship(spark)
    model, meta = sequence.fit(reports_of(spark, a.input), seq_len=a.seq_len, hidden=a.hidden, layers=a.layers, epochs=a.epochs, batch_size=a.batch_size, lr=a.lr, max_vessels=a.max_vessels, val_frac=a.val_frac, patience=a.patience, max_sequences=a.max_sequences or None)
    sequence.save(spark, model, meta, a.output_dir)


def score_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    ship(spark)
    model, meta, _ = sequence.load(spark, a.model_dir)
    p = reports_of(spark, a.input)
    p = points.vessels_of(p, ranking.sample_vessels(p, a.max_vessels, 123))
    scores = sequence.score(p, meta["mean"], meta["std"], model, meta["seq_len"], a.batch_size)
    top, summary = sequence.top(scores, a.top_frac), sequence.stats(scores)
    sinks.write_sorted(scores, [F.desc("anomaly_score"), F.col("mmsi"), F.col("event_id")], f"{a.output_dir}/scores")
    sinks.write_sorted(top, [F.col("rank")], f"{a.output_dir}/top")
    sinks.write_json(spark, summary.first().asDict(), f"{a.output_dir}/error_stats")
    sinks.write_text(spark, reports.sequence_report(summary, top, meta, {"input": a.input, "model": a.model_dir, "output": a.output_dir, "vessels scored": scores.select("mmsi").distinct().count(), "sequences": scores.count(), "top fraction": a.top_frac, "top count": top.count()}), f"{a.output_dir}/report")


def sequence_events_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    write_events(spark, keyed(read(spark, a.top)), reports_of(spark, a.points), "sequence", a)


def fleet_cmd(spark: SparkSession, a: argparse.Namespace) -> None:
    df = trajectory.with_derived(read(spark, a.features))
    if "delta_t_s" in df.columns:
        df = df.withColumn("delta_t_min", F.col("delta_t_s") / 60)
    sinks.write_json(spark, sinks.stats_as_json(stats.fleet_stats(df, [c for c in method_a.FLEET if c in df.columns])), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wakeline", description=__doc__)
    sub = top.add_subparsers(required=True)

    def add(name: str, run, *flags: tuple, **defaults) -> None:
        p = sub.add_parser(name)
        for flag, kind, default in flags:
            p.add_argument(flag, **({"action": "store_true"} if kind is bool else {"type": kind, "default": default, "required": default is ...} if default is not ... else {"type": kind, "required": True}))
        p.set_defaults(run=run, **defaults)

    add("prepare", prepare_cmd, ("--input", str, ...), ("--output-dir", str, ...), ("--no-log-dist", bool, False))
    add("forest", forest_cmd, ("--x", str, ...), ("--model-out", str, ...), ("--scores-out", str, ...), ("--top-out", str, ...), ("--summary-out", str, ...), ("--n-estimators", int, 200), ("--max-samples", str, "auto"), ("--contamination", str, "auto"), ("--random-state", int, 42), ("--top-frac", float, 0.01))
    add("fleet-stats", fleet_cmd, ("--features", str, ...), ("--out", str, ...))
    add("explain", explain_cmd, ("--top", str, ...), ("--features", str, ...), ("--out", str, ...), ("--top-n", int, None))
    add("classify", classify_cmd, ("--explain", str, ...), ("--ref-stats", str, ...), ("--out-dir", str, ...), ("--threshold", str, "p95"))
    add("events", events_cmd, ("--classified-dir", str, ...), ("--points", str, ...), ("--out-dir", str, ...), ("--n-top", int, 5), ("--n-random", int, 5), ("--random-seed", int, 42))
    add("fit-sequences", fit_cmd, ("--input", str, ...), ("--output-dir", str, ...), ("--seq-len", int, 10), ("--hidden", int, 64), ("--layers", int, 2), ("--epochs", int, 30), ("--batch-size", int, 512), ("--lr", float, 1e-3), ("--max-vessels", int, 2000), ("--val-frac", float, 0.15), ("--patience", int, 5), ("--max-sequences", int, 100_000))
    add("score-sequences", score_cmd, ("--input", str, ...), ("--model-dir", str, ...), ("--output-dir", str, ...), ("--max-vessels", int, 5000), ("--top-frac", float, 0.01), ("--batch-size", int, 2048))
    add("sequence-events", sequence_events_cmd, ("--top", str, ...), ("--points", str, ...), ("--out-dir", str, ...), ("--n-top", int, 10), ("--n-random", int, 10), ("--context-s", int, 3600), ("--random-seed", int, 42))
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("wakeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
