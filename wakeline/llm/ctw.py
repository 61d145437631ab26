"""LM scoring by context-tree weighting over binary-decomposed bytes.

Each of a byte's eight bits is predicted in the context of the bits before it and of up to DEPTH bytes before it. A node
(context, bits so far) has counts of zeros and ones from the training texts, their Krichevsky-Trofimov probability, and
a weighted one: half the KT estimate, half the product of the weighted ones of the contexts that are a byte longer. The
weight that a node gives its own estimate follows from the two; a bit's probability mixes the estimates of all
depths along its path, and a context never seen predicts 1/2. A text's score is the sum over its bytes (A-Z
lowered) and an end sign.

A byte's probability depends on it and the DEPTH bytes before it only. Blocks ask for their distinct such grams (and words,
for the base score), the part that owns the grams of two last bytes builds those bytes' subtree and answers. The two
upper levels (at most 256 * 255 nodes) are summed up first and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Words, mix, pieces, text_buffer
from .exchange import ask, blocks, gathered, lookup, partitions_for

DEPTH = 5
#: Stands before and after a text; no byte of UTF-8.
EDGE = 0xFF
WORD_BIT = np.uint64(1 << 63)
END_WORD = np.uint64(0x7FFFFFFFFFFFFFFF) | WORD_BIT
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)  # fixed values: Stirling's series


def lgamma(x: np.ndarray) -> np.ndarray:
    y, low = x + 8.0, np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1.0)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and every end: the text's index, and the DEPTH bytes before it and itself as a number."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    room = np.full(len(data) + n * (DEPTH + 1), EDGE, np.uint8)
    place = np.arange(len(data)) + text * (DEPTH + 1) + DEPTH
    room[place] = LOWER[data]
    last = at[1:] + np.arange(n) * (DEPTH + 1) + DEPTH
    where = np.concatenate([place, last])
    g = np.zeros(len(where), np.uint64)
    for k in range(DEPTH, -1, -1):
        g = (g << np.uint64(8)) | room[where - k]
    return np.concatenate([text, np.arange(n)]), g


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and key of every word, and of the end of every text."""
    w = Words(LOWER[data], at)
    n = len(at) - 1
    return np.concatenate([w.text, np.arange(n)]), np.concatenate([w.hash | WORD_BIT, np.full(n, END_WORD)])


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Words by their hash; grams by the two bytes before the last, so that a part has whole subtrees."""
    near = mix((keys >> np.uint64(8)) & np.uint64(0xFFFF))
    return (np.where(keys & WORD_BIT, keys, near) % np.uint64(n)).astype(np.int64)


class Node:
    """Nodes of one depth in order of key: key (context, bits so far), counts, log of the weighted probability, own weight."""

    def __init__(self, key, zeros, ones, below=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        self.weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.own = np.ones(len(key)) if below is None else np.exp(kt - np.log(2) - self.weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _bits(g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of a gram's last byte's bits: the node's key at full depth, and the bit."""
    byte, context = g & np.uint64(0xFF), g & ~np.uint64(0xFF)
    for k in range(8):
        yield context | np.uint64(1 << k) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k)) & np.uint64(1)


def _above(key: np.ndarray, depth: int) -> np.ndarray:
    """The key at a smaller depth: without the oldest bytes."""
    return key & np.uint64((1 << (8 * depth + 8)) - 1)


def subtrees(g: np.ndarray, n: np.ndarray) -> list[Node]:
    """Nodes of the depths DEPTH down to 2 from grams and their counts."""
    keys, bits = zip(*_bits(g), strict=True)
    bit = np.concatenate(bits).astype(np.float64)
    count = np.tile(n.astype(np.float64), 8)
    levels = [Node(*_sum_by(np.concatenate(keys), count * (1 - bit), count * bit))]
    for depth in range(DEPTH - 1, 1, -1):
        below = levels[-1]
        key, zeros, ones, weighted = _sum_by(_above(below.key, depth), below.zeros, below.ones, below.weighted)
        levels.append(Node(key, zeros, ones, weighted))
    return levels


def upper(rows: list[tuple[int, float, float, float]]) -> tuple[Node, Node]:
    """Depth 1 and 0 from the sums over the depth below."""
    key = np.array([r[0] for r in rows], np.uint64)
    order = np.argsort(key)
    zeros, ones, below = (np.array([r[k] for r in rows])[order] for k in (1, 2, 3))
    one = Node(key[order], zeros, ones, below)
    return one, Node(*(x := _sum_by(_above(one.key, 0), one.zeros, one.ones, one.weighted))[:3], x[3])


def log10_of(g: np.ndarray, levels: list[Node]) -> np.ndarray:
    """log10 of the mixed probability of each gram's last byte; levels: depth 0 first."""
    out = np.zeros(len(g))
    for key, bit in _bits(g):
        p, rest = np.zeros(len(g)), np.ones(len(g))
        for depth, level in enumerate(levels):
            if not len(level.key):
                break
            k = _above(key, depth)
            i = np.minimum(np.searchsorted(level.key, k), len(level.key) - 1)
            seen = level.key[i] == k  # below a context never seen there is none
            own = np.where(seen, level.own[i], 0.0)
            p += rest * own * level.one[i]
            p += np.where(seen, 0.0, rest * 0.5)
            rest = np.where(seen, rest * (1 - own), 0.0)
        p += rest * 0.5
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _sum_by(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count_kernel(n_parts: int):
    """Of training texts: each task's distinct words and grams with their counts, as rows for the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK_BYTES // 2):
                data, at = text_buffer(batch.column(0))
                for _, k in (grams(data, at), tokens(data, at)):
                    k, n = np.unique(k, return_counts=True)
                    keys.append(k)
                    counts.append(n)
                if sum(map(len, keys)) > 1 << 21:
                    keys, counts = ([x] for x in _merged(keys, counts))
        if keys:
            k, n = _merged(keys, counts)
            yield from ask(0, k, n.astype("<i8").view(np.uint8).reshape(-1, 8), n_parts, part_of).combine_chunks().to_batches()

    return run


def _upper_kernel(table: pa.Table) -> pa.Table:
    """A part's sums for depth 1 (key, zeros, ones, log weighted), and in row -1 its words: distinct and all."""
    _, keys, shares, _ = gathered(table, 8)
    key, n = _sum_by(keys, shares.copy().view("<i8")[:, 0])
    word = (key & WORD_BIT) > 0
    two = subtrees(key[~word], n[~word])[-1]
    k, zeros, ones, below = _sum_by(_above(two.key, 1), two.zeros, two.ones, two.weighted)
    return pa.table({"key": pa.array(np.append(k.astype(np.int64), -1)), "zeros": np.append(zeros, float(word.sum())), "ones": np.append(ones, float(n[word].sum())), "below": np.append(below, 0.0)})


def scored(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    Learns from the rows that are not held out; with none every bit costs 1. A null text is an empty one: its end is
    all there is to score. Words are known by 64-bit hashes; log probabilities of bytes travel in single precision (a
    text's score is exact to about 7 digits). Repeated rows count, and are scored, one by one. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    n_parts = partitions_for(docs)
    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(_count_kernel(n_parts), "part int, block int, keys binary, shares binary")
    sums = parts.repartition(n_parts, "part").groupBy("part").applyInArrow(_upper_kernel, "key long, zeros double, ones double, below double")
    rows = [tuple(r) for r in sums.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()]  # 256 * 255 + 1 at most
    distinct, total = next(((int(r[1]), int(r[2])) for r in rows if r[0] == -1), (0, 0))
    top_of = spark.sparkContext.broadcast(tuple(reversed(upper([r for r in rows if r[0] != -1]))))

    def chunks(table: pa.Table) -> Iterator[tuple]:
        for whole in table.combine_chunks().to_batches():
            for batch in pieces(whole, "text", CHUNK_BYTES // 2):
                data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
                yield batch, data, at, np.asarray(batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), bool)

    def request(table: pa.Table, again: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Keys and training counts; again: keys alone, with each chunk's distinct keys and their places."""
        keys, counts, kept = [], [], []
        for batch, data, at, out in chunks(table):
            own = []
            for text, k in (grams(data, at), tokens(data, at)):
                if again:
                    k, i = np.unique(k, return_inverse=True)
                    own.append((text.astype(np.int32), k, i.astype(np.int32)))
                    keys.append(k)
                else:
                    held = out[text]
                    for part, weight in ((k[~held], 1), (k[held], 0)):
                        part, n = np.unique(part, return_counts=True)
                        keys.append(part)
                        counts.append(n * weight)
            kept.append((batch, at, out, own))
        if again:
            return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64), None, kept
        k, n = _merged(keys, counts)
        return k, n.astype("<i8").view(np.uint8).reshape(-1, 8), kept

    def answer(keys: np.ndarray, inverse: np.ndarray, shares: np.ndarray) -> np.ndarray:
        n = np.bincount(inverse, shares.copy().view("<i8")[:, 0], len(keys))
        value = n.copy()
        gram = (keys & WORD_BIT) == 0
        known = gram & (n > 0)
        if gram.any():
            levels = [*top_of.value, *reversed(subtrees(keys[known], n[known]))]
            value[gram] = log10_of(keys[gram], levels).astype(np.float32)  # half the bytes to send
        return value[inverse]

    def apply(keys: np.ndarray, values: np.ndarray, kept: list) -> pa.Table:
        done = []
        for batch, at, out, ((text, k, i), (word_text, word, j)) in kept:
            n = len(at) - 1
            score = np.bincount(text, values[np.searchsorted(keys, k)][i], n)
            c = values[np.searchsorted(keys, word)]
            done.append(pa.table({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), "held_out": pa.array(out), "n_tokens": np.bincount(word_text, minlength=n).astype(np.int64),
                "n_known": np.bincount(word_text, (c > 0)[j], n).astype(np.int64), "logs": np.bincount(word_text, np.log10(c + 1)[j], n), "score": score, "n_bytes": np.diff(at),
            }))
        return pa.concat_tables(done) if done else empty

    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]).empty_table()
    blk = blocks(docs, F.xxhash64("doc_id", "text"), n_parts)
    out = lookup(blk, request, answer, apply, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long", n=n_parts, width=8, dtype=np.float64, part_of=part_of)
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


