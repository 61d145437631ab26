"""The transition method end to end: pairs, fleet statistics, forest, explain table, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import explain, iforest, prepare, ranking, rules

FLEET = ("sog_curr", "abs_dsog", "abs_dcog", "delta_t_s", "delta_t_min", "dist_m", "implied_kts")
MODEL_FEATURES = ("delta_t_s", "dist_m", "dsog", "dcog", "dheading", "sog_curr", "abs_dsog", "abs_dcog", "abs_dheading", "implied_kts", "cog_curr")


def score(pairs: DataFrame, *, features: tuple[str, ...] = MODEL_FEATURES, n_estimators: int = 200, max_samples: str = "auto", contamination: str = "auto", random_state: int = 42, log_dist: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """Scores of all transitions, the forest's nodes, metadata. A numeric contamination sets the offset at that quantile."""
    share = iforest.parse_contamination(contamination)
    keys = ["event_id", *prepare.META]
    x, scaler = prepare.prepare_features(pairs.select(*keys, *features), log_dist=log_dist, carry=("event_id",))
    nodes, meta = iforest.fit(x, scaler["features"], ["event_id"], n_trees=n_estimators, max_samples=max_samples, seed=random_state)
    scored = iforest.score(x, nodes, meta).select(*keys, "anomaly_score", "decision_function")
    if share is not None:
        meta["offset"] = -stats.percentiles(scored, ["anomaly_score"], [1 - share]).first()["p0"]
        scored = scored.withColumn("decision_function", -F.col("anomaly_score") - meta["offset"])
    return scored, nodes, meta | {"scaler": scaler, "contamination": contamination}


def run(pairs: DataFrame, *, top_frac: float = 0.01, threshold: str = "p95", **forest) -> dict[str, DataFrame | dict]:
    """All tables of the method: scores, top, explain, classified, by category, summary."""
    scored, nodes, meta = score(pairs, **forest)
    order = [F.desc("anomaly_score"), F.col("event_id")]
    top, n = ranking.top_fraction(scored, order, top_frac, "ceil")
    fleet = stats.fleet_stats(pairs, FLEET)
    explained = explain.explain_table(top.drop("rank"), pairs.drop("event_id"), [F.desc("anomaly_score"), *map(F.col, prepare.META)])
    classified = rules.classify(explained, rules.thresholds(fleet, threshold))
    return {"scores": scored, "nodes": nodes, "meta": meta | {"n_rows": n}, "top": top, "fleet": fleet, "explain": explained, "classified": classified, "categories": rules.category_rows(classified), "unclassified": classified.where("n_categories = 0"), "summary": rules.category_summary(classified)}
