"""Per-vessel ordered operators: transitions, sequence features, sliding windows and their coverage.

Everything hangs on one window specification, so Spark sorts each vessel's reports once; a large vessel is cut into time ranges
with halos (chunks.py), so it is several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored
from .chunks import HALO, by_vessel, core, helpers, is_split, place, reports, split

# Columns of the sequence model, in order.
SEQ_FEATURES = ("sog", "cog_sin", "cog_cos", "heading_sin", "heading_cos", "delta_lat", "delta_lon", "log_delta_t")
#: Added before rounding to 6 places: exact ties go up, whatever the last bit of the double.
TIE = 1e-9
# What each error group sums, by place in SEQ_FEATURES, and its text in output tables.
ERR_GROUPS = {"speed": (0,), "course": (1, 2), "heading": (3, 4), "position_jump": (5, 6), "time_gap": (7,)}
ERR_REASONS = {
    "speed": "unexpected speed change",
    "course": "unexpected course change",
    "heading": "unexpected heading change",
    "position_jump": "unexpected position jump",
    "time_gap": "unexpected time gap pattern",
}


def transitions(points: DataFrame) -> DataFrame:
    """Features of each pair of consecutive reports of a vessel (the first report of a vessel has none).

    Features are rounded to 6 places (metres to 3), so that comparing them with a percentile doesn't hang on the last bit.
    """
    points = split(points, 1, 0)
    w = by_vessel(points)
    prev = {c: F.lag(c).over(w) for c in ("t_s", "lat", "lon", "sog", "cog", "heading", "event_id")}
    dt = (F.col("t_s") - prev["t_s"]).cast("double")
    dist = S.haversine(prev["lat"], prev["lon"], "lat", "lon")
    out = points.select(
        "event_id", "mmsi", "vessel_type", prev["t_s"].alias("t_prev"), F.col("t_s").alias("t_curr"), dt.alias("delta_t_s"), (dt / 60).alias("delta_t_min"),
        F.round(dist, 3).alias("dist_m"), F.round(F.col("sog") - prev["sog"], 6).alias("dsog"), S.turn(prev["cog"], "cog").alias("dcog"),
        S.turn(prev["heading"], "heading").alias("dheading"), F.col("sog").alias("sog_curr"), F.col("cog").alias("cog_curr"), *helpers(points),
    ).where("t_prev is not null")
    return with_derived(core(out))


def with_derived(df: DataFrame) -> DataFrame:
    """abs_* and implied speeds, from the columns that are there."""
    have = set(df.columns)
    for c in ("dsog", "dcog", "dheading"):
        if c in have:
            df = df.withColumn(f"abs_{c}", F.abs(F.col(c).cast("double")))
    if {"dist_m", "delta_t_s"} <= have:
        df = df.withColumn("implied_mps", F.round(S.implied_mps("dist_m", "delta_t_s") + TIE, 6)).withColumn("implied_kts", F.round(S.implied_knots("dist_m", "delta_t_s") + TIE, 6))
    return df


def sequence_features(points: DataFrame, seq_len: int = 10) -> DataFrame:
    """The model's columns for each report of a vessel with at least seq_len + 2 of them; dt is the gap before it (null for
    the first), nth its place. Where a vessel was split, its halos are in it until core() takes them off."""
    points = split(points, seq_len + 1, seq_len)
    w = by_vessel(points)
    dt = F.greatest((F.col("t_s") - F.lag("t_s").over(w)).cast("double"), F.lit(0.0))
    lagged = points.withColumns({
        "dt": F.when(F.lag("t_s").over(w).isNotNull(), dt), "nth": place(points), "reports": reports(points),
        "delta_lat": F.coalesce(F.col("lat") - F.lag("lat").over(w), F.lit(0.0)), "delta_lon": F.coalesce(F.col("lon") - F.lag("lon").over(w), F.lit(0.0)),
    })
    cog, heading = F.radians(S.course_or_zero("cog")), F.radians(S.heading_or_zero("heading"))
    return lagged.where(F.col("reports") >= seq_len + 2).select(
        "event_id", "mmsi", "t_s", "lat", "lon", F.col("sog").alias("sog_raw"), "dt", "nth", S.clip("sog", S.SOG_LOW, S.SOG_HIGH).alias("sog"),
        F.sin(cog).alias("cog_sin"), F.cos(cog).alias("cog_cos"), F.sin(heading).alias("heading_sin"), F.cos(heading).alias("heading_cos"),
        "delta_lat", "delta_lon", F.log1p(F.coalesce("dt", F.lit(0.0))).alias("log_delta_t"), *helpers(points),
    )


def window_validity(features: DataFrame, seq_len: int = 10, max_gap: float = S.MAX_GAP_S) -> DataFrame:
    """valid: the report ends a run of seq_len + 1 without a gap above max_gap inside it (the gap before its first report
    is not looked at)."""
    gaps = F.max("dt").over(by_vessel(features).rowsBetween(-(seq_len - 1), 0))
    return features.withColumn("valid", (F.col("nth") > seq_len) & F.coalesce(gaps <= max_gap, F.lit(False)))


def window_coverage(validity: DataFrame, seq_len: int = 10) -> DataFrame:
    """weight: how many valid windows hold the report; the sequences' moments are the reports' with this weight."""
    return core(validity.withColumn("weight", F.sum(F.col("valid").cast("long")).over(by_vessel(validity).rowsBetween(0, seq_len))))


def sequences(validity: DataFrame, seq_len: int = 10, features: tuple[str, ...] = SEQ_FEATURES, last: int | None = None) -> DataFrame:
    """A row per valid window: seq (seq_len + 1 arrays of features; with last, only so many of them from the end), times of its
    first, last but one and last report, and the last report's place and raw speed."""
    w = by_vessel(validity)
    rows = validity.withColumns({
        "seq": F.collect_list(F.array(*features)).over(w.rowsBetween(-seq_len if last is None else 1 - last, 0)), "t_start": F.lag("t_s", seq_len).over(w), "t_prev": F.lag("t_s", 1).over(w),
    })
    return rows.where(F.col("valid") & ~F.col(HALO) if is_split(validity) else F.col("valid")).select("event_id", "mmsi", "t_start", "t_prev", F.col("t_s").alias("t_curr"), "lat", "lon", F.col("sog_raw").alias("sog"), "seq")


def scaler_moments(coverage: DataFrame, features: tuple[str, ...] = SEQ_FEATURES, floor: float = S.STD_FLOOR) -> DataFrame:
    """feature, mean, std over all rows of all windows (population), without building the windows. Deviations are taken
    from the mean (two passes over the aggregate), so large means don't cancel. The weighted reports are written once, so that
    no pass works the windows out again."""
    w = F.col("weight")
    coverage, _ = stored(coverage.select(w, *features))
    means = coverage.agg(F.sum(w).alias("n"), *(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"m_{c}") for c in features))
    spread = coverage.crossJoin(F.broadcast(means)).agg(F.first("n").alias("n"), *(F.first(f"m_{c}").alias(f"m_{c}") for c in features), *(F.sqrt(F.try_divide(F.sum(w * (F.col(c) - F.col(f"m_{c}")) ** 2), F.sum(w))).alias(f"s_{c}") for c in features))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < floor, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for k, c in enumerate(features))))
    return spread.select("n", each.alias("x")).select("x.place", "x.feature", "x.mean", "x.std", "n")


def scaled(seq: Column, mean: list[float], std: list[float]) -> Column:
    """Every row of a sequence as z-scores."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(seq, lambda row: F.zip_with(F.zip_with(row, m, lambda a, b: a - b), s, lambda a, b: a / b))


def squared_errors(predicted: Column, actual: Column) -> Column:
    return F.zip_with(predicted, actual, lambda a, b: (a - b) * (a - b))


def with_errors(df: DataFrame, errors: str = "errors") -> DataFrame:
    """anomaly_score (mean squared error) and err_<group> (sums of squared errors)."""
    e = F.col(errors)
    n = len(SEQ_FEATURES)
    df = df.withColumn("anomaly_score", F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / n)
    for name, places in ERR_GROUPS.items():
        total = e[places[0]]
        for p in places[1:]:
            total = total + e[p]
        df = df.withColumn(f"err_{name}", total)
    return df


def dominant_error() -> tuple[Column, Column]:
    """The group with the largest error (ties: the first) and its reason."""
    labels = list(ERR_GROUPS)
    errs = F.array(*(F.col(f"err_{k}") for k in labels))
    label = F.element_at(F.array(*map(F.lit, labels)), F.array_position(errs, F.array_max(errs)).cast("int"))
    reasons = F.create_map(*(F.lit(x) for k, v in ERR_REASONS.items() for x in (k, v)))
    return label, F.element_at(reasons, label)
