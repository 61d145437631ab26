"""Embedding whitening: one-sided Jacobi SVD of a blockwise TSQR.

Each block of rows is centred and reduced to a triangular factor R; factors are stacked and reduced again, first along a task's
rows, then over a tree of tasks. A factor keeps the exact sums of its rows, so when two meet, the difference of their means is
one more row of the stack (Chan's update): what arrives at the top is the R of all rows, centred at the mean of all, from one
scan. Plane rotations then make R's columns orthogonal: their lengths are the standard deviations (times sqrt(n)), and the
rotations, accumulated, the components. R'R is never formed, so small deviations keep their digits.

R has dimension x dimension entries; that, and at most 32 components, is all that the driver sees and broadcasts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, finite_vectors

#: Entries become floor(SCALE * c) + SHIFT; beyond +-CLIP (no real embedding) they count as +-CLIP.
SCALE, SHIFT, CLIP = 64, 1_000_000, 2.0**53
#: Entries of a block, and factors that meet in one task of the tree.
BLOCK_ENTRIES, FAN_IN = 1 << 18, 16
#: A component whose deviation is below this share of the largest counts as none.
NOTHING = 1e-12


def integers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -CLIP, CLIP).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, with the whole part of the mean taken off in integers."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    return (x - np.array(whole, np.int64)) - np.array([r / n for r in rest])


class Factor:
    """Of some rows: their number, exact sums, and the R of the rows centred at their mean."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray):
        self.n, self.sums, self.r = n, sums, r

    @classmethod
    def of(cls, x: np.ndarray) -> Factor:
        n, high, low = len(x), x >> 32, x & 0xFFFFFFFF  # sums of either half fit into 64 bits
        sums = [(int(a) << 32) + int(b) for a, b in zip(high.sum(0), low.sum(0), strict=True)]
        return cls(n, sums, np.linalg.qr(centred(x, n, sums), mode="r"))

    def with_(self, other: Factor) -> Factor:
        n = self.n + other.n
        apart = [float((b * self.n - a * other.n) / (self.n * other.n)) for a, b in zip(self.sums, other.sums, strict=True)]
        row = math.sqrt(self.n * other.n / n) * np.array(apart)
        r = np.linalg.qr(np.vstack([self.r, other.r, row]), mode="r")
        return Factor(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], r)


class Spread:
    """Of some whitened rows: their number, mean, and the sum of products about it."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, w: np.ndarray) -> Spread:
        mean = w.mean(0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def with_(self, other: Spread) -> Spread:
        n, apart = self.n + other.n, other.mean - self.mean
        products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        return Spread(n, self.mean + apart * (other.n / n), products)


def blocks(batches: Iterator[pa.RecordBatch], width: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows of it, their integers) for each vector length in turn (or for the one told), in blocks of bounded size."""
    for batch in batches:
        for d, rows, values in finite_vectors(batch.column(batch.schema.get_field_index("embedding"))):
            if width in (None, d):
                step = max(1, BLOCK_ENTRIES // d)
                for k in range(0, len(rows), step):
                    yield batch, rows[k : k + step], integers(values[k : k + step])


STATE = "width long, node long, n long, state binary"


def _rows(states: dict[int, object], node: int) -> Iterator[pa.RecordBatch]:
    for width, s in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([node]), pa.array([s.n]), pa.array([pickle.dumps(s)], pa.binary())], ["width", "node", "n", "state"])


def _gather(make: Callable[[np.ndarray], object], width: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for _, _, x in blocks(batches, width):
            new, d = make(x), x.shape[1]
            states[d] = states[d].with_(new) if d in states else new
        yield from _rows(states, TaskContext.get().partitionId())

    return run


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    width, node = (k.as_py() for k in key)
    states = sorted(zip(table["node"].to_pylist(), table["state"].to_pylist(), strict=True))
    total = None
    for _, packed in states:
        s = pickle.loads(packed)
        total = s if total is None else total.with_(s)
    return pa.table({"width": [width], "node": [node], "n": [total.n], "state": pa.array([pickle.dumps(total)], pa.binary())})


def merged(states: DataFrame) -> DataFrame:
    """One row per width: all its states, merged by nodes of FAN_IN in a tree (in order, so that reruns agree)."""
    states = checkpointed(states)
    last = states.agg(F.max("node")).first()[0] or 0
    while True:
        up = F.floor(F.col("node") / FAN_IN).cast("long")
        states = states.groupBy("width", up.alias("up")).applyInArrow(_meet, STATE)
        if last < FAN_IN:
            return states
        last //= FAN_IN


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and right singular vectors as columns: plane rotations make r's columns orthogonal, all
    disjoint pairs of a round at once."""
    a, v = np.array(r, float), np.eye(r.shape[1])
    d, least = a.shape[1], (1e-15 * np.linalg.norm(a)) ** 2  # shorter columns are rounding noise
    players = np.arange(d + d % 2)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            i, j = players[:half], players[half:][::-1]
            real = (i < d) & (j < d)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx * yy)
            turn = (np.minimum(xx, yy) > least) & (np.abs(xy) > 1e-15 * scale)
            if turn.any():
                largest = max(largest, float((np.abs(xy[turn]) / scale[turn]).max()))
                i, j, x, y = i[turn], j[turn], x[:, turn], y[:, turn]
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, i], a[:, j] = c * x - s * y, s * x + c * y
                p, q = v[:, i], v[:, j]
                v[:, i], v[:, j] = c * p - s * q, s * p + c * q
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if largest < 1e-14:
            break
    length = np.sqrt((a * a).sum(0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


class Whitening:
    """What a fit leaves: n, sums, components (columns), standard deviations and shares of the variance; null deviations for
    directions without variance."""

    def __init__(self, factor: Factor, most: int):
        length, v = jacobi(factor.r)
        k = min(most, len(factor.sums))
        total = float((length * length).sum())
        self.n, self.sums, self.width = factor.n, factor.sums, len(factor.sums)
        v = v[:, :k]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
        self.deviation = length[:k] / math.sqrt(factor.n)
        self.real = length[:k] > NOTHING * max(float(length.max(initial=0)), 1e-300)
        self.explained = (length[:k] ** 2 / total).tolist() if total > 0 else [None] * k
        self.matrix = v / np.where(self.real, self.deviation, np.inf)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.matrix

    def squares(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n*x - S)^2, exact; null where a long cannot hold it."""
        rough = (float(self.n) * centred(x, self.n, self.sums)) ** 2
        whole, rest = (np.array(k, object) for k in zip(*(divmod(s, self.n) for s in self.sums), strict=True))
        out: list[int | None] = []
        if len(x) and rough.sum(1).max() < 2.0**61:
            exact = self.n * (x - whole.astype(np.int64)) - rest.astype(np.int64)
            return pa.array((exact * exact).sum(1))
        for row in x:
            value = sum((self.n * (int(c) - w) - r) ** 2 for c, w, r in zip(row, whole, rest, strict=True))
            out.append(value if value < 1 << 63 else None)
        return pa.array(out, pa.int64())


def fitted(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """The whitening of a table with a column embedding; None where no row is usable. Vectors of another length than the
    commonest one (the longest of those, in a tie) are left out, as are empty ones."""
    of_width = merged(vectors.select("embedding").mapInArrow(_gather(Factor.of), STATE))
    top = of_width.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()  # one factor
    return Whitening(pickle.loads(top[0]["state"]), most) if top else None


def identity_error(vectors: DataFrame, fit_of) -> float | None:
    """The largest entry of |covariance of the whitened rows - identity|, measured on all rows (centred, divisor n), over the
    components with variance; None where there are none."""
    fit = fit_of.value
    if not fit.real.any():
        return None

    def make(x: np.ndarray) -> Spread:
        return Spread.of(fit_of.value.whitened(x)[:, fit_of.value.real])

    total = pickle.loads(merged(vectors.select("embedding").mapInArrow(_gather(make, fit.width), STATE)).first()["state"])
    return float(np.abs(total.products / total.n - np.eye(len(total.mean))).max())


def _whiten_kernel(fit_of, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = fit_of.value
        k = len(fit.real)
        for batch, rows, x in blocks(batches, fit.width):
            w = fit.whitened(x)
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            flat = pa.array(w.ravel(), mask=np.tile(~fit.real, len(rows)))
            m = len(rows) * k
            columns = [
                batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, fit.n)), fit.squares(x).take(each),
                flat, pa.array(fit.explained * len(rows), pa.float64()), pa.array([error] * m, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(vectors: DataFrame, most: int = 32) -> DataFrame:
    """One row per usable vector and component (at most `most`): vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or empty, holds null or non-finite entries, or has another length than most is dropped. Repeated
    rows count, and are returned, each; a null vec_id stays null. A direction without variance (fewer rows than dimensions,
    constant entries) has null in whitened and is left out of identity_error; explained is null where nothing varies. A
    deviation that a long cannot hold is null. Without usable rows the result is empty. Other columns are ignored.
    Three scans: factors, the covariance of the whitened rows, the result; nothing is shuffled but factors.
    """
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fitted(vectors, most)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    fit_of = vectors.sparkSession.sparkContext.broadcast(fit)  # dimension x `most` doubles
    error = identity_error(vectors, fit_of)
    return vectors.select("vec_id", "embedding").mapInArrow(_whiten_kernel(fit_of, error), schema)
