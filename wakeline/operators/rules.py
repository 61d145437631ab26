"""Rule-based labels: a category holds when one of its features exceeds the fleet's percentile."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ranks import with_percent_rank

# The categories with their features, in order of the labels, and texts that appear in output tables.
RULES = {"speed": ("sog_curr", "abs_dsog"), "turn": ("abs_dcog",), "timegap": ("delta_t_s",), "distance": ("dist_m", "implied_kts")}
DESCRIPTIONS = {
    "speed": "high reported SOG or sudden speed change (sog_curr or |dsog| > fleet {pct})",
    "turn": "large course change (|dcog| > fleet {pct})",
    "timegap": "long gap between pings (delta_t_s > fleet {pct})",
    "distance": "large position jump (dist_m or implied_kts > fleet {pct})",
}
NO_RULE = "no single feature exceeds fleet threshold"
ASSIGNMENT = "multi-label (OR)"
FALLBACK = "unclassified"
PERCENTILES = ("p50", "p95", "p99", "p999")


def thresholds(stats: DataFrame, pct: str) -> dict[str, float | None]:
    """feature -> threshold, from a few rows of fleet statistics."""
    if pct not in PERCENTILES:
        raise ValueError(f"threshold must be one of {', '.join(PERCENTILES)}")
    return {r["feature"]: r[pct] for r in stats.collect()}


def exceeds(df: DataFrame, feature: str, limit: float | None) -> Column:
    """Strictly above; no threshold: never."""
    return F.lit(False) if limit is None else number_or_zero(df, feature) > limit


def number_or_zero(df: DataFrame, feature: str) -> Column:
    """A feature's number; a missing column or value, a text that is no number, NaN and infinities count as 0."""
    if feature not in df.columns:
        return F.lit(0.0)
    kind = df.schema[feature].dataType.typeName()
    value = S.finite(S.to_number(feature)) if kind == "string" else S.finite(feature)
    return F.coalesce(value, F.lit(0.0))


def classify(df: DataFrame, limits: dict[str, float | None], rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """Adds cat_<name>, categories (comma-joined, or unclassified), n_categories and cat_score_<name>."""
    if "implied_kts" not in df.columns and {"dist_m", "delta_t_s"} <= set(df.columns):
        df = df.withColumn("implied_kts", F.round(S.implied_knots_or_zero(number_or_zero(df, "dist_m"), number_or_zero(df, "delta_t_s")), 6))
    for name, features in rules.items():
        df = df.withColumn(f"cat_{name}", reduce(or_, (exceeds(df, f, limits.get(f)) for f in features)))
    flags = [F.when(F.col(f"cat_{n}"), F.lit(n)) for n in rules]
    df = df.withColumn("categories", F.coalesce(F.nullif(F.concat_ws(",", *flags), F.lit("")), F.lit(FALLBACK)))
    df = df.withColumn("n_categories", sum((F.col(f"cat_{n}").cast("int") for n in rules), F.lit(0)))
    for name, features in rules.items():
        ratios = [S.ratio_to_threshold(number_or_zero(df, f), F.lit(float(limits[f]))) for f in features if limits.get(f) is not None]
        df = df.withColumn(f"cat_score_{name}", F.bround(F.greatest(F.lit(0.0), F.lit(0.0), *ratios), 4))
    return df


def category_rows(classified: DataFrame, rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """A row per category that a row has: category, category_score, percentile_rank (average ties) within it."""
    each = F.array(*(F.struct(F.lit(n).alias("category"), F.col(f"cat_{n}").alias("held"), F.col(f"cat_score_{n}").alias("category_score")) for n in rules))
    rows = classified.withColumn("x", F.explode(each)).where("x.held").select(*classified.columns, "x.category", "x.category_score")
    return with_percent_rank(rows, "category_score", ["category"])


def category_summary(classified: DataFrame, rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """Always one row per category and one for the unclassified: category, n, pct of all rows."""
    sums = classified.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(F.sum(F.col(f"cat_{n}").cast("long")), F.lit(0)).alias(n) for n in rules), F.coalesce(F.sum((F.col("n_categories") == 0).cast("long")), F.lit(0)).alias(FALLBACK))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in (*rules, FALLBACK))))
    return sums.select("total", each.alias("x")).select("x.category", "x.n", F.bround(100.0 * F.col("x.n") / F.greatest("total", F.lit(1)), 2).alias("pct"))


def multi_category_count(classified: DataFrame) -> DataFrame:
    return classified.agg(F.coalesce(F.sum((F.col("n_categories") > 1).cast("long")), F.lit(0)).alias("n_multi"))


def rule_text(limits: dict[str, float | None], rules: dict[str, tuple[str, ...]] = RULES, between: str = " OR ") -> dict[str, str]:
    """Each category's rule with its thresholds to 2 places; a feature without one never exceeds it (inf)."""
    return {n: between.join(f"{f} > {float('inf') if limits.get(f) is None else limits[f]:.2f}" for f in fs) for n, fs in rules.items()}


def summary_table(classified: DataFrame, limits: dict[str, float | None], level: str, rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """The summary as it is published: counts and shares with the thresholds and rules that led to them."""
    texts = rule_text(limits, rules, ", ")
    rows = [(n, level, texts[n], DESCRIPTIONS.get(n, n).format(pct=level), ASSIGNMENT) for n in rules] + [(FALLBACK, level, "-", NO_RULE, "-")]
    told = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "threshold_level", "thresholds", "rule_description", "assignment"), row, strict=True))) for row in rows)))
    summary = category_summary(classified, rules).select(F.col("category"), F.col("n").alias("n_anomalies"), F.col("pct").alias("pct_of_if_total"), told.alias("x"))
    return summary.where("category = x.name").select("category", "n_anomalies", "pct_of_if_total", "x.threshold_level", "x.thresholds", "x.rule_description", "x.assignment")
