"""Transitions of a stream whose reports come late: a buffer in order of time, the gap rule, and late reports told apart.

A vessel's reports wait until one that is `lateness` seconds younger has come; they then leave in order of time, so any order
within the lateness gives the rows of the batch. A report that is older than what has already left comes out as a late one,
in the same stream (late is true), to be written apart and counted: nothing is dropped in silence. When nothing has come for
`idle` seconds of the clock, what waits leaves and the vessel's state goes; its next report is a first one again (0: never).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators import rules
from ..operators.trajectory import with_derived

REPORT = "t_s bigint, event_id bigint, lat double, lon double, sog double, cog double"
NAMES = [x.split()[0] for x in REPORT.split(", ")]
LAST = f"{REPORT}, run bigint"
OUT = "mmsi bigint, late boolean, event_id bigint, t_prev bigint, t_curr bigint, run bigint, lat0 double, lon0 double, lat1 double, lon1 double, sog0 double, sog1 double, cog0 double, cog1 double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(row: tuple) -> tuple:
    """A report as the state takes it: whole numbers, and None for missing ones."""
    return (int(row[0]), int(row[1]), *(None if x is None or x != x else float(x) for x in row[2:]))


class Ordered(StatefulProcessor):
    def __init__(self, lateness: int, idle: float, max_gap: float):
        self.lateness, self.idle, self.max_gap = lateness, idle, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", REPORT)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  (Spark's names)
        last = tuple(self.last.get()) if self.last.exists() else None
        came = [plain(r) for part in rows for r in part[NAMES].itertuples(index=False, name=None)]
        late = [r for r in came if last and r[:2] <= last[:2]]
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *(r for r in came if not last or r[:2] > last[:2])], key=lambda r: r[:2])
        newest = max([r[0] for r in waiting] or [0])
        ready = [r for r in waiting if r[0] <= newest - self.lateness]
        out, last = self.left(key, ready, last)
        self.waiting.put(waiting[len(ready) :]) if waiting[len(ready) :] else self.waiting.clear()
        if last:
            self.last.update(last)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self.frame(out + [(key[0], True, r[1], None, r[0], None, None, None, r[2], r[3], None, r[4], None, r[5]) for r in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803, ARG002
        out, _ = self.left(key, sorted(tuple(r) for r in self.waiting.get()), tuple(self.last.get()) if self.last.exists() else None)
        self.waiting.clear()
        self.last.clear()
        yield self.frame(out)

    def left(self, key: tuple, ready: list[tuple], last: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Transitions of reports that leave in order, and the last of them with the length of its run without a gap."""
        out = []
        for r in ready:
            run = 1 if last is None or r[0] - last[0] > self.max_gap else last[6] + 1
            if last is not None:
                out.append((key[0], False, r[1], last[0], r[0], run, last[2], last[3], r[2], r[3], last[4], r[4], last[5], r[5]))
            last = (*r, run)
        return out, last

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = [x.split()[1] for x in OUT.split(", ")]
        types = {"bigint": "Int64", "boolean": bool, "double": np.float64}
        return pd.DataFrame({x.split()[0]: pd.Series([r[k] for r in rows], dtype=types[kind]) for k, (x, kind) in enumerate(zip(OUT.split(", "), kinds, strict=True))})

    def close(self) -> None:
        pass


def ordered(points: DataFrame, *, lateness: int = 600, idle: float = 86_400, max_gap: float = S.MAX_GAP_S) -> DataFrame:
    """Streaming transitions (late is false; run is the number of reports since the last gap above max_gap, so a window of
    seq_len + 1 reports is valid from run seq_len + 1 on) and late reports (late is true). Columns of points: mmsi, t_s,
    event_id, lat, lon, sog, cog. The session keeps such state in RocksDB."""
    spark: SparkSession = points.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    raw = points.groupBy("mmsi").transformWithStateInPandas(Ordered(lateness, idle, max_gap), OUT, outputMode="Append", timeMode="ProcessingTime" if idle else "None")
    cog0, cog1 = S.finite("cog0"), S.finite("cog1")
    out = raw.select(
        "mmsi", "late", "event_id", "t_prev", "t_curr", "run", (F.col("t_curr") - F.col("t_prev")).cast("double").alias("delta_t_s"), F.round(S.haversine("lat0", "lon0", "lat1", "lon1"), 3).alias("dist_m"),
        F.round(F.col("sog1") - F.col("sog0"), 6).alias("dsog"), S.turn(cog0, cog1).alias("dcog"), F.col("sog1").alias("sog_curr"),
    )
    return with_derived(out)


def write_live(points: DataFrame, limits: dict[str, float | None], path: str, checkpoint: str, **settings):  # noqa: ANN003, ANN201
    """Starts the query: classified transitions below path/transitions, late reports below path/late (counting that table
    counts them)."""

    def both(batch: DataFrame, _: int) -> None:
        batch.persist()
        rules.classify(batch.where("not late").drop("late"), limits).write.mode("append").parquet(f"{path}/transitions")
        batch.where("late").select("mmsi", "event_id", F.col("t_curr").alias("t_s")).write.mode("append").parquet(f"{path}/late")
        batch.unpersist()

    return ordered(points, **settings).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).start()
