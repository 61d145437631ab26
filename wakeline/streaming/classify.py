"""Rules over a stream of position reports: each vessel's last report is the state, transitions come out as they complete.

The batch rules apply unchanged to the stream of transitions, as they only look at one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..operators import rules
from ..operators.trajectory import with_derived

COLUMNS = ["t_s", "event_id", "lat", "lon", "sog", "cog"]
OUT = "mmsi long, event_id long, t_prev long, t_curr long, lat0 double, lon0 double, lat1 double, lon1 double, sog0 double, sog1 double, cog0 double, cog1 double"
STATE = "t_s long, event_id long, lat double, lon double, sog double, cog double"


def _pairs(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Reports of a batch in order of time; one that is older than the last one seen is dropped."""
    rows = pd.concat(list(parts))[COLUMNS].sort_values(["t_s", "event_id"], kind="stable")
    if state.exists:
        last = pd.DataFrame([state.get], columns=COLUMNS)
        at = (int(last["t_s"].iloc[0]), int(last["event_id"].iloc[0]))
        rows = rows[[(int(t), int(e)) > at for t, e in zip(rows["t_s"], rows["event_id"], strict=True)]]
        rows = pd.concat([last, rows]) if len(rows) else last
    end = rows.iloc[-1]
    state.update((int(rows["t_s"].iloc[-1]), int(rows["event_id"].iloc[-1]), *(None if pd.isna(end[c]) else float(end[c]) for c in COLUMNS[2:])))
    a, b = rows.iloc[:-1], rows.iloc[1:]
    yield pd.DataFrame({
        "mmsi": key[0], "event_id": b["event_id"].to_numpy(np.int64), "t_prev": a["t_s"].to_numpy(np.int64), "t_curr": b["t_s"].to_numpy(np.int64),
        **{f"{c}{k}": x[c].to_numpy(float) for c in ("lat", "lon", "sog", "cog") for k, x in ((0, a), (1, b))},
    })


def transitions(points: DataFrame) -> DataFrame:
    """Streaming transitions of streaming reports (mmsi, t_s, event_id, lat, lon, sog, cog)."""
    raw = points.groupBy("mmsi").applyInPandasWithState(_pairs, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    cog0, cog1 = S.finite("cog0"), S.finite("cog1")
    out = raw.select(
        "event_id", "mmsi", "t_prev", "t_curr", (F.col("t_curr") - F.col("t_prev")).cast("double").alias("delta_t_s"), F.round(S.haversine("lat0", "lon0", "lat1", "lon1"), 3).alias("dist_m"),
        F.round(F.col("sog1") - F.col("sog0"), 6).alias("dsog"), S.turn(cog0, cog1).alias("dcog"), F.col("sog1").alias("sog_curr"),
    )
    return with_derived(out)


def classified(points: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    return rules.classify(transitions(points), limits)
