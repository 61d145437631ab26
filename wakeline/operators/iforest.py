"""Isolation Forest: trees from hash-chosen samples, built in parallel; scores by walking them in vectorised batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def mean_path(n: float) -> float:
    """Average length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def parse_max_samples(value: str | int | float, n: int) -> int:
    """auto: 256 at most; an int: that many; a float in (0, 1]: that share."""
    text = str(value).strip().lower()
    if text == "auto":
        return min(256, n)
    x = float(text)
    if "." not in text and "e" not in text:
        if int(text) < 1:
            raise ValueError("max_samples must be at least 1")
        return min(int(text), n)
    if not 0 < x <= 1:
        raise ValueError("a max_samples share must be in (0, 1]")
    return max(1, int(x * n))


def parse_contamination(value: str | float) -> float | None:
    """auto (None) or a number in (0, 0.5]."""
    text = str(value).strip().lower()
    if text == "auto":
        return None
    x = float(text)
    if not 0 < x <= 0.5:
        raise ValueError("contamination must be auto or in (0, 0.5]")
    return x


def build_tree(x: np.ndarray, tree: int, seed: int, limit: int | None = None) -> list[tuple]:
    """Nodes of one tree: random feature, uniform cut between its least and largest value in the node."""
    rng = np.random.Generator(np.random.PCG64([seed, tree]))
    limit = math.ceil(math.log2(max(len(x), 2))) if limit is None else limit
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][4 + side] = me
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        go = x[rows, f] <= cut
        nodes[me][2], nodes[me][3] = f, cut
        todo.append((rows[~go], depth + 1, me, 1))
        todo.append((rows[go], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, features: list[str], keys: list[str], *, n_trees: int = 200, max_samples: str | int | float = "auto", seed: int = 42, depth: int | None = None) -> tuple[DataFrame, dict]:
    """Nodes of all trees, and metadata. Each tree samples by its own hash order of the keys, without replacement.

    A bottom-k sample: a row is a candidate for a tree when its hash is below a cut that leaves about twice the sample, and
    each tree takes the least hashes. Rows, trees and hashes stay in generated code (no array is made for a row), and only
    candidates carry their features on: some 2 * n_trees * max_samples rows, whatever the size of the table.
    """
    n = df.count()
    psi = parse_max_samples(max_samples, n)
    share = min(1.0, 2.0 * psi / max(n, 1) + 20.0 / max(n, 1))
    cut = F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
    trees = F.explode(F.lit(list(range(n_trees)))).alias("__tree")
    drawn = df.select(*dict.fromkeys([*keys, *features]), trees).withColumn("__h", F.xxhash64(F.lit(seed), "__tree", *keys)).where(F.col("__h") <= cut)
    rows = drawn.select(F.col("__tree").alias("tree"), F.col("__h").alias("h"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("h", kind="stable").head(psi)
        return pd.DataFrame(build_tree(np.array(own["x"].tolist(), dtype=float), int(pdf["tree"].iloc[0]), seed, depth), columns=[c.split()[0] for c in NODES.split(", ")])

    trees = rows.groupBy("tree").applyInPandas(grow, NODES)
    return trees, {"n_trees": n_trees, "max_samples": psi, "n_rows": n, "features": features, "seed": seed, "offset": -0.5}


class Forest:
    """Trees as flat arrays."""

    def __init__(self, nodes: list[tuple], psi: int):
        nodes = sorted(nodes)
        first, self.roots = {}, []
        for k, r in enumerate(nodes):
            if r[0] not in first:
                first[r[0]] = k
                self.roots.append(k)
        base = np.array([first[r[0]] for r in nodes])
        a = np.array([r[2:] for r in nodes], dtype=float)
        self.feature = a[:, 0].astype(int)
        self.threshold = a[:, 1]
        self.left, self.right = (np.where(a[:, k] < 0, -1, a[:, k] + base).astype(int) for k in (2, 3))
        self.length = a[:, 5] + np.array([mean_path(s) for s in a[:, 4]])
        self.norm = mean_path(psi) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = rows
            while len(live):
                node = at[live]
                live = live[self.feature[node] >= 0]
                node = at[live]
                at[live] = np.where(x[live, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def score(df: DataFrame, nodes: DataFrame, meta: dict) -> DataFrame:
    """df with anomaly_score (larger is stranger, in (0, 1]) and decision_function. The forest's size is bounded by its
    parameters (n_trees * 2 * max_samples nodes)."""
    features = meta["features"]
    forest = df.sparkSession.sparkContext.broadcast(Forest([tuple(r) for r in nodes.collect()], meta["max_samples"]))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(forest.value.score(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    out = df.withColumn("anomaly_score", run(*(F.col(c).cast("double") for c in features)))
    return out.withColumn("decision_function", -F.col("anomaly_score") - meta.get("offset", -0.5))
