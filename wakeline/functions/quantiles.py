"""Exact order statistics of many columns at once, in a number of passes that depends neither on the columns nor the ranks.

A multi-select: every wanted rank (of any column) has an open interval that holds it. One pass sketches the intervals and so
proposes bounds on either side of each rank, one counts what lies below, at and between the bounds of all of them, and the
intervals shrink by the sketch's accuracy; a rank that falls on a bound is settled, so values repeated many times never stay
in an interval. When the intervals hold few rows, one pass fetches the settled values by counts of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an interval that one task may hold.
IN_ONE_TASK = 5_000_000
#: Of the sketch: its ranks are off by 1 / ACCURACY of the rows at most; bounds are taken twice as far away.
ACCURACY = 10_000


@dataclass
class Wanted:
    """The rank (from 0) among a column's values, and the open interval known to hold it."""

    column: str
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None
    settled: bool = False

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high


def _within(column: str, low: float | None, high: float | None) -> Column:
    c = F.col(column)
    inside = c.isNotNull()
    if low is not None:
        inside &= c > low
    if high is not None:
        inside &= c < high
    return inside


def _bounds(df: DataFrame, wanted: list[Wanted], accuracy: int) -> None:
    """One sketch pass and one counting pass: settles ranks or shrinks their intervals."""
    of: dict[tuple, list[Wanted]] = {}
    for w in wanted:
        of.setdefault(w.interval, []).append(w)
    aggs, asked = [], []
    for k, (interval, members) in enumerate(of.items()):
        places = sorted({min(1.0, max(0.0, (w.rank - w.below) / max(1, w.n - 1) + side * 2 / accuracy)) for w in members for side in (-1, 1)})
        value = F.when(_within(*interval), F.col(interval[0]).cast("double"))
        aggs.append(F.percentile_approx(value, F.array(*map(F.lit, places)), F.lit(accuracy)).alias(f"b{k}"))
        asked.append(places)
    sketched = df.agg(*aggs).first()
    counts, found = [], {}
    for k, interval in enumerate(of):
        found[interval] = bounds = sorted(set(sketched[f"b{k}"]), key=lambda b: (b != b, b))  # NaN last
        c, inside = F.col(interval[0]), _within(*interval)
        for i, b in enumerate(bounds):
            counts += [F.count_if(inside & (c < b)).alias(f"l{k}_{i}"), F.count_if(inside & (c == b)).alias(f"e{k}_{i}")]
    counted = df.agg(*counts).first()
    for k, (interval, members) in enumerate(of.items()):
        bounds = found[interval]
        for w in members:
            low, high, below, n = w.low, w.high, w.below, w.n
            for i, b in enumerate(bounds):
                less, equal = w.below + counted[f"l{k}_{i}"], counted[f"e{k}_{i}"]
                if less <= w.rank < less + equal:
                    w.value, w.settled = b, True
                    break
                if w.rank >= less + equal:  # the bound is below
                    low, below = b, less + equal
                else:
                    high, n = b, less - below
                    break
            else:
                n = w.n - (below - w.below)
            if not w.settled:
                w.low, w.high, w.below, w.n = low, high, below, n


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], sizes: dict[str, int], *, in_one_task: int = IN_ONE_TASK, accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
    """(column, rank) -> value, for ranks within 0 and the number of the column's non-null values (sizes) less 1.

    Two passes for each factor of about accuracy / 4 by which a column is larger than in_one_task, and one more. NaN is the
    largest value. No value is collected but those asked for.
    """
    wanted = [Wanted(c, k, sizes[c]) for c, ks in ranks.items() for k in sorted(set(ks))]
    while open_ := [w for w in wanted if not w.settled and w.n > in_one_task]:
        before = [w.n for w in open_]
        _bounds(df, open_, accuracy)
        if all(w.settled or w.n >= n for w, n in zip(open_, before, strict=True)):
            accuracy *= 4  # intervals of fewer rows than the sketch tells apart
    rest = [w for w in wanted if not w.settled]
    if rest:
        intervals = list(dict.fromkeys(w.interval for w in rest))
        pairs = F.array(*(F.when(_within(*i), F.struct(F.lit(k).alias("k"), F.col(i[0]).cast("double").alias("v"))) for k, i in enumerate(intervals)))
        values = df.select(F.explode(pairs).alias("x")).where("x is not null").groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
        # an interval has in_one_task rows at most
        upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
        asked = [(F.col("k") == intervals.index(w.interval)) & (w.rank - w.below >= F.col("upto") - F.col("n")) & (w.rank - w.below < F.col("upto")) for w in rest]
        hit = F.array(*(F.when(a, F.lit(i)) for i, a in enumerate(asked)))
        for r in upto.select("v", F.explode(F.array_compact(hit)).alias("i")).collect():  # one row for each rank asked for
            rest[r["i"]].value = r["v"]
    return {(w.column, w.rank): w.value for w in wanted}


def percentiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], in_one_task: int = IN_ONE_TASK, accuracy: int = ACCURACY) -> DataFrame:
    """One row per column: feature, and p0 .. pn for the quantiles, exact with linear interpolation, nulls left out."""
    names = [f"p{k}" for k in range(len(qs))]
    counted = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    if max(counted) <= in_one_task:
        array = F.array(*map(F.lit, qs))
        wide = df.agg(*(F.percentile(c, array).alias(c) for c in columns))
        long = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in columns))).alias("x"))
        return long.select("x.feature", *(F.col("x.q")[k].alias(n) for k, n in enumerate(names)))
    sizes = {c: counted[c] for c in columns}
    places = {c: [q * (n - 1) for q in qs] for c, n in sizes.items() if n}
    ranks = {c: [k for p in at for k in (int(p), min(int(p) + 1, sizes[c] - 1))] for c, at in places.items()}
    found = order_statistics(df, ranks, sizes, in_one_task=in_one_task, accuracy=accuracy)

    def at(c: str, p: float) -> float:
        a, b = found[c, int(p)], found[c, min(int(p) + 1, sizes[c] - 1)]
        return a + (b - a) * (p % 1) if p % 1 else a

    rows = [(c, *([at(c, p) for p in places[c]] if c in places else [None] * len(qs))) for c in columns]
    return df.sparkSession.createDataFrame(rows, ", ".join(["feature string", *(f"{n} double" for n in names)]))
