"""The explain table: top rows with their features and readable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .events import BROADCAST_ROWS
from .prepare import META, reorder
from .ranking import top_rows
from .trajectory import with_derived

# The order of the output's first columns.
FRONT = ["mmsi", "t_prev", "t_curr", "anomaly_score", "decision_function", "anomaly_rank", "anomaly_rank_pct", "delta_t_s", "dist_m", "implied_mps", "implied_kts", "dsog", "abs_dsog", "dcog", "abs_dcog", "dheading", "abs_dheading", "vessel_type"]


def _same(keys: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cond


def explain_join(top: DataFrame, features: DataFrame, keys: tuple[str, ...] = META) -> DataFrame:
    """Left join on the keys, nulls matching nulls; colliding feature columns get _feat; matched tells the found ones.

    The top rows' keys, where they are BROADCAST_ROWS at most, first pick their features by a broadcast semi join, so the join
    itself moves as many rows as the top list has, and not the whole table.
    """
    for side, df in (("top", top), ("features", features)):
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"{side} has no column {', '.join(missing)}")
    clash = set(top.columns) & set(features.columns) - set(keys)
    top = checkpointed(top)
    if top.count() <= BROADCAST_ROWS:
        wanted = top.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        features = features.join(F.broadcast(wanted), _same(keys), "left_semi")
    right = features.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"{c}_feat" if c in clash else c) for c in features.columns if c not in keys), F.lit(1).alias("__m"))
    return top.join(right, _same(keys), "left").withColumn("matched", F.col("__m").isNotNull()).drop("__m", *(f"__{k}" for k in keys))


def unmatched_count(joined: DataFrame) -> DataFrame:
    return joined.agg(F.sum((~F.col("matched")).cast("long")).alias("n_unmatched"))


def explain_table(top: DataFrame, features: DataFrame, order: list[Column], keys: tuple[str, ...] = META, top_n: int | None = None) -> DataFrame:
    """Joined, derived, ranked over the joined rows (duplicates on the right shift ranks), preferred columns first."""
    if top_n is not None:
        top = top.orderBy(*order).limit(top_n)
    joined = with_derived(explain_join(top, features, keys).drop("matched"))
    n = joined.count()
    out = top_rows(joined, order, max(n, 1), "anomaly_rank")
    pct = F.col("anomaly_rank") / F.lit(float(n)) if n > 1 else F.lit(1.0)
    return reorder(out.withColumn("anomaly_rank_pct", pct), FRONT)
