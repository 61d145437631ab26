"""Vessels of any size: time ranges of a vessel with halos, so that windows over its reports are several tasks.

A vessel with more than HOT_ROWS reports is cut at quantiles of its times. Each chunk also gets the last reports before it and
the first after it (its halo), as many as the windows reach; rows with the same time stay in one chunk. What is added up over
a vessel (places, numbers of reports) comes from the chunks' counts. Other vessels are chunk 0 and have no halo; where no
vessel is large, the table stays as it is.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Reports of a vessel that one task sorts.
HOT_ROWS = 5_000_000
#: Quantiles of a large vessel's times that it can be cut at: larger ones than this times HOT_ROWS have larger chunks.
CUTS = 1024
_cuts: WeakKeyDictionary = WeakKeyDictionary()
CHUNK, HALO, OFFSET, REPORTS = "__chunk", "__halo", "__offset", "__reports"


def is_split(df: DataFrame) -> bool:
    return CHUNK in df.columns


def helpers(df: DataFrame) -> list[str]:
    """The columns that later windows need."""
    return [c for c in (CHUNK, HALO) if c in df.columns]


def by_vessel(df: DataFrame, *extra: str) -> WindowSpec:
    return Window.partitionBy("mmsi", *([CHUNK] if is_split(df) else [])).orderBy("t_s", *(extra or ("event_id",)))


def place(df: DataFrame) -> Column:
    """A report's place within its vessel, from 1."""
    nth = F.row_number().over(by_vessel(df))
    return (nth + F.col(OFFSET)).cast("long") if is_split(df) else nth


def reports(df: DataFrame) -> Column:
    """The number of its vessel's reports."""
    whole = Window.partitionBy("mmsi", *([CHUNK] if is_split(df) else []))
    n = F.count(F.lit(1)).over(whole)
    return F.coalesce(F.col(REPORTS), n) if is_split(df) else n


def core(df: DataFrame) -> DataFrame:
    """Without halos and the columns that split added: each report once."""
    return df.where(~F.col(HALO)).drop(CHUNK, HALO, OFFSET, REPORTS) if is_split(df) else df


def cuts(points: DataFrame, hot_rows: int) -> DataFrame | None:
    """mmsi, cuts: for each large vessel the times at which its chunks after the first begin; None where no vessel is large.
    Over all vessels, 2 * rows / hot_rows of them at most."""
    large = points.groupBy("mmsi").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows)
    if large.isEmpty():
        return None
    large = checkpointed(large)
    own = points.join(F.broadcast(large.select("mmsi")), points["mmsi"].eqNullSafe(large["mmsi"]), "left_semi")
    found = own.groupBy("mmsi").agg(F.percentile_approx("t_s", F.lit([k / CUTS for k in range(1, CUTS)]), F.lit(10 * CUTS)).alias("at"), F.count(F.lit(1)).alias("rows"))
    step = F.greatest(F.lit(1), F.floor(CUTS / F.ceil(F.col("rows") / hot_rows)).cast("int"))
    return checkpointed(found.withColumn("step", step).select("mmsi", F.array_distinct(F.filter("at", lambda x, k: (k + 1) % F.col("step") == 0)).alias("cuts")))


def split(points: DataFrame, before: int, after: int, hot_rows: int | None = None) -> DataFrame:
    """points with chunks and halos of `before` and `after` reports, if there is a large vessel; otherwise points."""
    hot_rows = hot_rows or HOT_ROWS
    known = _cuts.setdefault(points, {})  # several windows over one table count its vessels once
    if hot_rows not in known:
        known[hot_rows] = cuts(points, hot_rows)
    at = known[hot_rows]
    if at is None:
        return points
    bounds = at.select(F.col("mmsi").alias("__m"), "cuts")
    chunk = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("t_s"))))
    cut = points.join(F.broadcast(bounds), F.col("mmsi").eqNullSafe(F.col("__m")), "left").withColumn(CHUNK, chunk)
    row = F.struct(*points.columns)
    hot = cut.where("cuts is not null").select("mmsi", CHUNK, "t_s", "event_id", row.alias("row"))
    ends = Window.partitionBy("mmsi", CHUNK)
    hot = hot.withColumns({"head": F.row_number().over(ends.orderBy("t_s", "event_id")), "tail": F.row_number().over(ends.orderBy(F.desc("t_s"), F.desc("event_id")))})
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("t_s", "event_id", "row"))))
    edges = checkpointed(hot.groupBy("mmsi", CHUNK).agg(F.count(F.lit(1)).alias("n"), listed(F.col("head") <= after).alias("heads"), listed(F.col("tail") <= before).alias("tails")))
    # a vessel's chunks in order; each has a report at least, so so many of them hold enough
    order = Window.partitionBy("mmsi").orderBy(CHUNK)
    near = lambda c, a, b: F.flatten(F.collect_list(c).over(order.rowsBetween(a, b)))
    edges = edges.withColumns({
        "earlier": near("tails", -before, -1) if before else F.array().cast(edges.schema["tails"].dataType), "later": near("heads", 1, after) if after else F.array().cast(edges.schema["heads"].dataType),
        "rows_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), REPORTS: F.sum("n").over(Window.partitionBy("mmsi")),
    })
    edges = edges.withColumn("earlier", F.slice("earlier", F.greatest(F.lit(1), F.size("earlier") - before + 1), before or 1)).withColumn("later", F.slice("later", 1, after or 1))
    edges = checkpointed(edges.withColumn(OFFSET, F.col("rows_before") - F.size("earlier")).select("mmsi", CHUNK, OFFSET, REPORTS, F.concat("earlier", "later").alias("halo")))
    told = edges.select(F.col("mmsi").alias("__e"), F.col(CHUNK).alias("__c"), OFFSET, REPORTS)
    same = F.col("mmsi").eqNullSafe(F.col("__e")) & (F.col(CHUNK) == F.col("__c"))
    main = cut.join(F.broadcast(told), same, "left").select(*points.columns, CHUNK, F.lit(False).alias(HALO), F.coalesce(OFFSET, F.lit(0)).alias(OFFSET), REPORTS)
    halo = edges.select(CHUNK, OFFSET, REPORTS, F.explode("halo").alias("x")).select("x.row.*", CHUNK, F.lit(True).alias(HALO), OFFSET, REPORTS)
    return main.unionByName(halo)
