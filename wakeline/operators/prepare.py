"""Preparation of a feature table for the forest: coercion, log distance, constant columns, medians, z-scores."""

from __future__ import annotations

import math
import sys
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import percentiles
from ..sources.shared import checkpointed

META = ("mmsi", "t_prev", "t_curr")
NOT_FEATURES = ("vessel_type",)
#: Steps between a column's median and the value farthest from it, in which values are counted for its moments.
STEPS = 1 << 40


def reorder(df: DataFrame, front: list[str]) -> DataFrame:
    """Preferred columns first, the rest behind in their order."""
    head = [c for c in front if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def constant_columns(df: DataFrame, columns: list[str], nulls_count: bool = False) -> DataFrame:
    """feature, constant: whether a column has one value at most; with nulls_count, null is a value. One aggregate."""
    tests = []
    for c in columns:
        one = F.min(c).eqNullSafe(F.max(c))
        if nulls_count:
            nulls = F.count(F.lit(1)) - F.count(c)
            one = one & ((nulls == 0) | (F.count(c) == 0))
        tests.append(F.struct(F.lit(c).alias("feature"), F.coalesce(one, F.lit(True)).alias("constant")))
    return df.agg(F.array(*tests).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def missing_count(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(sum((F.sum(F.col(c).isNull().cast("long")) for c in columns), F.lit(0)).alias("n_missing"))


def training_table(df: DataFrame, features: list[str], keys: list[str]) -> tuple[DataFrame, list[str], dict[str, int | list[str]]]:
    """A feature table as the forest takes it: numbers, missing ones 0, columns of one value dropped (null is a value there).

    Returns the table, the features left, and what was done: n_missing and dropped. Raises ValueError with no feature left.
    """
    num = df.select(*keys, *(S.finite(F.col(c).try_cast("double")).alias(c) for c in features))
    missing = missing_count(num, features).first()["n_missing"] or 0
    filled = num.select(*keys, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features))
    dropped = {r["feature"] for r in constant_columns(filled, features, nulls_count=True).where("constant").collect()}
    left = [c for c in features if c not in dropped]
    if not left:
        raise ValueError("no usable feature column")
    return filled.select(*keys, *left), left, {"n_missing": missing, "dropped": sorted(dropped)}


def moments(df: DataFrame, centers: dict[str, float]) -> tuple[dict[str, float], dict[str, float | None]]:
    """Mean and sample deviation (None for one row) of columns without nulls, the same whatever the order of the rows.

    Distances from a center within the column's range (a median is best) are whole numbers of steps, 2^40 of them to the farthest
    value, and their sums and sums of squares are exact.
    """
    far = df.agg(*(F.max(F.abs(F.col(c) - F.lit(m))).alias(c) for c, m in centers.items())).first()
    step = {c: max(far[c] / STEPS, sys.float_info.min) for c in centers}

    def steps(c: str) -> Column:
        return F.floor((F.col(c) - F.lit(centers[c])) / F.lit(step[c]) + 0.5).cast("decimal(13,0)")

    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(steps(c)).alias(f"s_{c}") for c in centers), *(F.sum(steps(c) * steps(c)).alias(f"q_{c}") for c in centers)).first()
    n, mean, std = sums["n"], {}, {}
    for c in centers:
        s, q = int(sums[f"s_{c}"]), int(sums[f"q_{c}"])
        mean[c] = centers[c] + float(Fraction(s, n)) * step[c]
        std[c] = math.sqrt(Fraction(n * q - s * s, n * (n - 1))) * step[c] if n > 1 else None
    return mean, std


def prepare_features(df: DataFrame, *, keys: tuple[str, ...] = META, log_dist: bool = True, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Keys beside z-scored features, and the scaler. Every other column but vessel_type (and those carried) is a feature.

    In order: coerce, log1p of dist_m, drop constant columns, fill with the exact median (then 0), z-score with the
    sample deviation (0 counts as 1); both from exact sums. Raises ValueError when no feature is left.
    """
    names = [c for c in df.columns if c not in (*keys, *NOT_FEATURES, *carry)]
    num = df.select(*(F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in (*keys, *carry)), *(S.finite(F.col(c).try_cast("double")).alias(c) for c in names))
    if log_dist and "dist_m" in names:
        num = num.withColumn("dist_m", F.when(F.col("dist_m") > -1, F.log1p("dist_m")))
    num = checkpointed(num)  # written once: what led to it is not worked out again for each of the passes below
    constant = {r["feature"] for r in constant_columns(num, names).where("constant").collect()} if names else set()
    names = [c for c in names if c not in constant]
    if not names:
        raise ValueError("no usable feature column")
    medians = {r["feature"]: r["p0"] for r in percentiles(num, names, [0.5]).collect()}
    filled = num.select(*keys, *carry, *(F.coalesce(F.col(c), F.lit(medians[c]), F.lit(0.0)).alias(c) for c in names))
    mean, std = moments(filled, {c: medians[c] or 0.0 for c in names})
    std = {c: std[c] or 1.0 for c in names}
    out = filled.select(*keys, *carry, *(((F.col(c) - mean[c]) / std[c]).alias(c) for c in names))
    return out, {"features": names, "median": medians, "mean": mean, "std": std, "dropped": sorted(constant)}
