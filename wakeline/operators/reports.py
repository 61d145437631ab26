"""Text reports from small aggregates."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import RULES, category_summary, multi_category_count, rule_text
from .trajectory import ERR_GROUPS


def dominant_counts(top: DataFrame) -> DataFrame:
    """A row per error label, absent ones with 0: dominant_error, n, pct."""
    labels = list(ERR_GROUPS)
    sums = top.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(F.sum((F.col("dominant_error") == x).cast("long")), F.lit(0)).alias(x) for x in labels))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("dominant_error"), F.col(x).alias("n")) for x in labels)))
    return sums.select("total", each.alias("x")).select("x.dominant_error", "x.n", F.bround(100.0 * F.col("x.n") / F.greatest("total", F.lit(1)), 2).alias("pct"))


def _part(title: str, lines: list[str]) -> list[str]:
    return ["", title, "-" * len(title), *lines]


def _head(title: str, facts: dict) -> list[str]:
    return [title, "=" * len(title), f"written: {datetime.datetime.now(datetime.UTC).isoformat(timespec='seconds')}", *(f"{k}: {v}" for k, v in facts.items())]


def forest_report(meta: dict, summary: DataFrame, n_top: int, files: dict[str, str] | None = None) -> str:
    """Files, numbers of rows and features, parameters, and the score's summary to 8 places."""
    s = summary.first().asDict()
    told = {"n_samples": meta.get("n_rows", meta.get("n_samples")), "n_features": len(meta["features"]), "train_time_sec": f"{meta.get('train_seconds', 0.0):.6f}", "top_fraction": f"{meta.get('top_frac', 0.0):.6f}", "top_count": n_top}
    parameters = [f"{k}: {v}" for k, v in meta.items() if k not in ("features", "n_rows", "n_samples", "train_seconds", "top_frac")]
    lines = _head("Isolation Forest summary", (files or {}) | told) + _part("Parameters", parameters) + [f"train_seconds: {meta.get('train_seconds')}"] * ("train_seconds" in meta)
    return "\n".join(lines + _part("anomaly_score (larger is more anomalous)", [f"{k}: {v:.8f}" for k, v in s.items() if v is not None]))


def category_report(classified: DataFrame, limits: dict[str, float | None], level: str = "", files: dict[str, str] | None = None) -> str:
    """Files, rules with their thresholds, counts and shares, and how many rows have more than one category."""
    counts = category_summary(classified, RULES).collect()  # a row for each category
    total, multi = classified.count(), multi_category_count(classified).first()[0]
    lines = _head("Category summary", (files or {}) | {"total": f"{total:,}", "threshold level": level, "assignment": "multi-label (a row can have 0 and more categories)"})
    lines += _part("Rules", [f"{n}: {t}" for n, t in rule_text(limits).items()]) + _part("Results", [f"{r['category']}: {r['n']:,} ({r['pct']:.1f} %)" for r in counts])
    return "\n".join([*lines, f"more than one: {multi:,} ({100 * multi / max(total, 1):.1f} %)"])


def sequence_report(stats: DataFrame, top: DataFrame, meta: dict | None = None, facts: dict | None = None) -> str:
    """Files and counts, the errors' distribution, the model's thresholds on held-out data, and the top list's dominant errors."""
    s, meta = stats.first().asDict(), meta or {}
    lines = _head("Sequence model summary", (facts or {}) | {k: meta[k] for k in ("seq_len", "features") if k in meta})
    lines += _part("Errors of all scored sequences", [f"{k}: {v:.6f}" for k, v in s.items() if v is not None])
    limits = meta.get("thresholds", {})
    lines += _part("Thresholds on held-out sequences", [f"{k}: {limits[k]:.6f}" for k in ("p95", "p99") if limits.get(k) is not None]) if limits else []
    return "\n".join(lines + _part("Dominant errors of the top list", [f"{r['dominant_error']}: {r['n']:,} ({r['pct']:.1f} %)" for r in dominant_counts(top).collect()]))
