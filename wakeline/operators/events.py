"""Events for figures: selection, context around each, and the tables behind each figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import checkpointed
from .ranking import first_per_vessel, sample_rows

#: Rows of a bounded side (some tens of bytes each) that are broadcast.
BROADCAST_ROWS = 500_000

MIN_CONTEXT = {"speed": 2, "turn": 3, "distance": 3, "timegap": 0, "sequence": 3}
# Texts of the manifest.
SKIPPED, SKIPPED_SEQUENCE = "skipped (not enough context points)", "skipped (not enough context)"
#: What a figure of gaps shows where the fleet has no statistics (seconds): median and p99.
GAP_DEFAULTS = (60.0, 300.0)


def score_order(df: DataFrame, *keys: str) -> list[Column]:
    """By category_score where there is one, else by anomaly_score."""
    return [F.desc("category_score" if "category_score" in df.columns else "anomaly_score"), *map(F.col, keys)]


def top_events(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The best row of each of the n best vessels."""
    order = score_order(df, *keys)
    return first_per_vessel(df, order).orderBy(*order).limit(n)


def remainder(df: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of vessels that aren't among the top."""
    return df.join(top.select("mmsi").distinct(), "mmsi", "left_anti").select(df.columns)


def sample_events(df: DataFrame, n_top: int, n_random: int, seed: int, *keys: str) -> DataFrame:
    """Top events and a seeded sample of the remainder, with sample_kind."""
    top = top_events(df, n_top, *keys)
    rest = sample_rows(remainder(df, top), n_random, seed, *keys)
    return top.withColumn("sample_kind", F.lit("top")).unionByName(rest.withColumn("sample_kind", F.lit("random")))


def context(events: DataFrame, points: DataFrame, seconds: int = S.CONTEXT_S) -> DataFrame:
    """events (key, mmsi, t_prev, t_curr) with every report of their vessel within the seconds around them; an event without
    any report stays once, with null report columns.

    An interval join by time bins: each event asks in the bins that it meets, each report is in one bin, and an inner join on
    vessel and bin keeps the pairs whose times fit. So a vessel's reports are dealt by time, the asking side is the one that
    is broadcast (when it has BROADCAST_ROWS rows at most; otherwise both are shuffled by vessel and bin), and reports are
    read once. What was found is then joined to the events, without the reports.
    """
    bins = max(1, 2 * seconds)
    ev = checkpointed(events.withColumn("__id", F.monotonically_increasing_id()))
    low, high = F.col("t_prev") - seconds, F.col("t_curr") + seconds
    met = F.when(low <= high, F.sequence(F.floor(low / bins), F.floor(high / bins)))
    asked = ev.select("__id", F.col("mmsi").alias("__mmsi"), low.alias("__low"), high.alias("__high"), F.explode(met).alias("__bin"))
    n = ev.agg(F.sum(F.size(met))).first()[0] or 0
    p = points.select(F.col("mmsi").alias("p_mmsi"), F.col("t_s").alias("p_t"), F.col("event_id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in ("lat", "lon", "sog", "cog")), F.floor(F.col("t_s") / bins).alias("p_bin"))
    near = (F.col("p_mmsi") == F.col("__mmsi")) & (F.col("p_bin") == F.col("__bin")) & F.col("p_t").between(F.col("__low"), F.col("__high"))
    found = p.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, near).select("__id", "p_t", "p_id", "p_lat", "p_lon", "p_sog", "p_cog")
    return ev.join(checkpointed(found), "__id", "left").drop("__id")


def segments(ctx: DataFrame) -> DataFrame:
    """segment: before t_prev, inside (both ends included), after t_curr; gap_before and gap_after with the ends in both;
    later: from t_curr on."""
    t = F.col("p_t")
    label = F.when(t < F.col("t_prev"), "before").when(t <= F.col("t_curr"), "inside").when(t > F.col("t_curr"), "after")
    return ctx.withColumns({"segment": label, "gap_before": t <= F.col("t_prev"), "gap_after": t >= F.col("t_curr"), "later": t >= F.col("t_curr")})


def enough(ctx: DataFrame, kind: str, key: str = "key") -> DataFrame:
    """Events with as many reports around them as the figure needs."""
    n = F.count("p_t").over(Window.partitionBy(key))
    return ctx.withColumn("n_context", n).where(F.col("n_context") >= MIN_CONTEXT[kind])


def _along(key: str):
    return Window.partitionBy(key).orderBy("p_t", "p_id")


def pairwise_turn(ctx: DataFrame, key: str = "key") -> DataFrame:
    """abs_turn between consecutive reports of the context."""
    return ctx.withColumn("abs_turn", F.round(F.abs(S.wrap_angle(F.lag("p_cog").over(_along(key)), "p_cog")), 6))


def pairwise_distance(ctx: DataFrame, key: str = "key") -> DataFrame:
    w = _along(key)
    return ctx.withColumn("segment_m", F.round(S.haversine(F.lag("p_lat").over(w), F.lag("p_lon").over(w), "p_lat", "p_lon"), 6))


def peak(ctx: DataFrame, value: str, key: str = "key", where: str = "segment = 'inside'") -> DataFrame:
    """Per event: the largest value and its time, the first on ties."""
    best = F.struct(F.col(value), -F.col("p_t"))
    return ctx.where(where).where(F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias("peak"), F.max_by("p_t", best).alias("peak_t"))


def jump_ends(ctx: DataFrame, key: str = "key") -> DataFrame:
    """Per event: the last report before it and the first one inside."""
    last, first = F.struct("p_t", "p_id"), F.struct("p_t", "p_id")
    before, inside = F.col("segment") == "before", F.col("segment") == "inside"
    return ctx.groupBy(key).agg(
        F.max_by("p_lat", F.when(before, last)).alias("from_lat"), F.max_by("p_lon", F.when(before, last)).alias("from_lon"),
        F.min_by("p_lat", F.when(inside, first)).alias("to_lat"), F.min_by("p_lon", F.when(inside, first)).alias("to_lon"),
    )


def with_jump_km(ends: DataFrame) -> DataFrame:
    """The jump's length in kilometres."""
    return ends.withColumn("jump_km", S.haversine("from_lat", "from_lon", "to_lat", "to_lon") / 1000)


def time_marks(events: DataFrame) -> DataFrame:
    """The middle of each event (epoch seconds), clock times of its ends and middle, and its length in minutes."""
    mid = S.midpoint("t_prev", "t_curr")
    return events.withColumns({"mid_s": mid, "from_hm": S.clock("t_prev"), "mid_hm": S.clock(mid), "to_hm": S.clock("t_curr"), "minutes": (F.col("t_curr") - F.col("t_prev")) / 60})


def gap_bars(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Three bars in minutes per event: the fleet's median and p99 gap and this one."""
    s = stats.where("feature = 'delta_t_s'").agg(F.first("p50").alias("p50"), F.first("p99").alias("p99"))
    fleet = events.crossJoin(F.broadcast(s))  # one row
    bars = F.array(F.struct(F.lit("fleet_median").alias("bar"), F.coalesce("p50", F.lit(GAP_DEFAULTS[0])).alias("s")), F.struct(F.lit("fleet_p99").alias("bar"), F.coalesce("p99", F.lit(GAP_DEFAULTS[1])).alias("s")), F.struct(F.lit("this").alias("bar"), F.col("delta_t_s").alias("s")))
    return fleet.select("key", F.explode(bars).alias("x")).select("key", "x.bar", (F.col("x.s") / 60).alias("minutes"))


def error_bars(events: DataFrame) -> DataFrame:
    """Five bars per sequence event."""
    names = [c for c in events.columns if c.startswith("err_")]
    return events.select("key", F.explode(F.array(*(F.struct(F.lit(c).alias("bar"), F.col(c).alias("error")) for c in names))).alias("x")).select("key", "x.*")


def speed_lines(ctx: DataFrame, stats: DataFrame, feature: str = "sog_curr") -> DataFrame:
    """The context with the fleet's lines (null where the fleet has none)."""
    lines = stats.where(F.col("feature") == feature).agg(F.first("p95").alias("line_p95"), F.first("p99").alias("line_p99"))
    return ctx.crossJoin(F.broadcast(lines))  # one row


def manifest(events: DataFrame, points: DataFrame, kind: str, seconds: int = S.CONTEXT_S) -> DataFrame:
    """A row per event: type, nth of its sample kind, n_context, status and file name (empty when skipped), with its times and
    scores (null where events lack one)."""
    n = context(events, points, seconds).groupBy("key").agg(F.count("p_t").alias("n_context"))
    nth = F.row_number().over(Window.partitionBy("sample_kind").orderBy(F.desc("score"), "key"))
    out = events.withColumn("nth", nth).join(n, "key")
    ok = F.col("n_context") >= MIN_CONTEXT[kind]
    name = F.format_string(f"{kind}_%s_%03d_mmsi_%s.png", F.col("sample_kind"), F.col("nth"), F.col("mmsi").cast("string"))
    scores = [F.col(c).cast("double").alias(c) if c in events.columns else F.lit(None).cast("double").alias(c) for c in ("anomaly_score", "category_score", "percentile_rank")]
    skipped = SKIPPED_SEQUENCE if kind == "sequence" else SKIPPED
    return out.select("key", F.lit(kind).alias("type"), "mmsi", "t_prev", "t_curr", *scores, "sample_kind", "nth", "n_context", F.when(ok, "saved").otherwise(skipped).alias("status"), F.when(ok, name).otherwise("").alias("file"))
