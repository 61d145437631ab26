"""The scoring of one vessel as a table function, for callers of SQL.

    SELECT * FROM score_vessel(TABLE(points) PARTITION BY mmsi ORDER BY (t_s, event_id), array(...), array(...))

Spark gives the function a vessel's reports in order; it keeps the last seq_len + 1 of them and gives a row for each valid
window, so a vessel needs no more memory than a window, however many reports it has.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import scalars as S
from .trajectory import ERR_GROUPS

SEQ_LEN = 10
COLUMNS = "event_id bigint, mmsi bigint, t_start double, t_prev double, t_curr double, lat double, lon double, sog double, anomaly_score double, " + ", ".join(f"err_{k} double" for k in ERR_GROUPS)


class ScoreVessel:
    """eval(report, mean, std): squared errors of persistence in z-scores of the sequence features. The report needs event_id,
    mmsi, t_s, lat, lon, sog, cog, heading; an error that a null takes part in is null. A vessel of fewer than SEQ_LEN + 2
    reports gives nothing, so a vessel's first window waits for the report after it."""

    def __init__(self) -> None:
        self.kept: deque = deque(maxlen=SEQ_LEN + 1)
        self.nth = 0
        self.waiting: tuple | None = None

    def eval(self, report, mean, std):  # noqa: ANN001, ANN201  (Spark's signature)
        before = self.kept[-1] if self.kept else None
        gap = None if before is None else max(float(report["t_s"] - before["t"]), 0.0)
        now = {"t": report["t_s"], "gap": gap, "lat": report["lat"], "lon": report["lon"]}
        now["x"] = self.scaled(report, before, gap, mean, std)
        self.kept.append(now)
        self.nth += 1
        if self.nth == SEQ_LEN + 2 and self.waiting is not None:
            yield self.waiting
        if self.nth <= SEQ_LEN or max(r["gap"] for r in list(self.kept)[1:]) > S.MAX_GAP_S:
            return
        row = self.scored(report, before, now)
        if self.nth == SEQ_LEN + 1:
            self.waiting = row
        else:
            yield row

    @staticmethod
    def scaled(report, before, gap, mean, std) -> list:  # noqa: ANN001
        course, heading, speed = report["cog"], report["heading"], report["sog"]
        course = math.radians(course or 0.0)
        heading = math.radians(0.0 if heading is None or heading == S.HEADING_UNKNOWN else heading)
        moved = [0.0 if before is None or before[c] is None or report[c] is None else report[c] - before[c] for c in ("lat", "lon")]
        values = [None if speed is None else min(max(speed, S.SOG_LOW), S.SOG_HIGH), math.sin(course), math.cos(course), math.sin(heading), math.cos(heading), *moved, math.log1p(gap or 0.0)]
        return [None if v is None else (v - m) / s for v, m, s in zip(values, mean, std, strict=True)]

    def scored(self, report, before, now) -> tuple:  # noqa: ANN001
        errors = [None if a is None or b is None else (a - b) * (a - b) for a, b in zip(before["x"], now["x"], strict=True)]
        total = lambda e: None if None in e else sum(e)
        groups = [total([errors[k] for k in places]) for places in ERR_GROUPS.values()]
        mean = None if None in errors else sum(errors) / len(errors)
        first = self.kept[0]["t"]
        return (report["event_id"], report["mmsi"], float(first), float(before["t"]), float(now["t"]), report["lat"], report["lon"], report["sog"], mean, *groups)


def register(spark: SparkSession, name: str = "score_vessel") -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, udtf(ScoreVessel, returnType=COLUMNS))
