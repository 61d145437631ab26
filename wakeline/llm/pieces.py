"""SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

Every segmentation of a text into pieces has weight exp(theta * sum of piece log-probabilities). The forward pass sums
the weights up to each place of the lattice, the backward pass draws the pieces from the end by those sums, with
numbers that hash the row's key: reruns, retries and other partitionings give the same pieces. Places without a
one-character piece fall back to byte pieces, so decoding gives every text back, whatever it holds.

No piece of the vocabulary has a space after its first run of spaces, or a line end, so the lattice of a text is a chain
of independent lattices: one per run of spaces with the word behind it. Each distinct one is filtered once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, mix, release, segment_hash, text_buffer
from .common import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A piece's log-probability is -ln(1 + its merge rank); a character from byte pieces costs this much more than the rarest.
FALLBACK = 10.0


class Vocabulary:
    """Pieces of a model file: bytes (a space for the word mark), score, id; ids of the byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        self.size = m.get_piece_size()
        self.pieces: list[tuple[bytes, float, int]] = []
        self.bytes = np.full(256, -1, np.int32)
        for i in range(self.size):
            if m.is_byte(i):
                self.bytes[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.pieces.append((m.id_to_piece(i).replace("▁", " ").encode(), m.get_score(i), i))
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces: it can't give every text back")
        if any(b"\n" in p or b" " in p.lstrip(b" ") for p, _, _ in self.pieces):
            raise ValueError("a piece of the model spans two words")


class Lattice:
    """The vocabulary as a byte trie in arrays, and as a table for decoding."""

    def __init__(self, vocabulary: Vocabulary, theta: float):
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for text, _, i in vocabulary.pieces:
            at = 0
            for b in text:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][b]
            piece[at] = i
        order = sorted(range(len(children)), key=lambda k: not children[k])  # inner nodes first; the root stays 0
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order), dtype=np.int32)
        self.inner = sum(map(bool, children))
        self.next = np.zeros((self.inner, 256), np.int32)
        for k, c in enumerate(children):
            for b, to in c.items():
                self.next[new[k], b] = new[to]
        self.piece = np.asarray(piece, np.int32)[order]
        ranks = np.zeros(vocabulary.size)
        table = [b""] * vocabulary.size
        for text, score, i in vocabulary.pieces:
            ranks[i], table[i] = -score, text
        self.logp = -theta * np.log1p(ranks)
        self.fallback = theta * (-np.log1p(vocabulary.size) - FALLBACK)
        self.bytes = vocabulary.bytes
        for b in range(256):
            table[vocabulary.bytes[b]] = bytes([b])
        self.width = np.asarray([len(x) for x in table], np.int64)
        self.from_ = np.concatenate([[0], np.cumsum(self.width)])
        self.pool = np.frombuffer(b"".join(table), np.uint8)

    def edges(self, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece (-1: byte pieces) of every edge in the texts of u; places are numbered with one more for
        each text, so that a text's end is not the next one's start."""
        n = len(u)
        head = (u & 0xC0) != 0x80
        head[at[:-1]] = True
        start = np.flatnonzero(head)
        text = np.searchsorted(at, start, side="right") - 1
        stop = at[text + 1]
        following = np.concatenate([start[1:], [n]])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        node, pos, end, which = np.zeros(len(start), np.int32), start, stop, np.arange(len(start))
        single = np.zeros(len(start), bool)
        k = 0
        while len(pos):
            node = self.next[node, u[pos]]
            live = node > 0
            node, pos, end, which = node[live], pos[live] + 1, end[live], which[live]
            piece = self.piece[node]
            hit = piece >= 0
            found.append((which[hit], pos[hit], piece[hit]))
            single[which[hit][pos[hit] == following[which[hit]]]] = True
            live = (node < self.inner) & (pos < end)
            node, pos, end, which = node[live], pos[live], end[live], which[live]
            k += 1
        bare = np.flatnonzero(~single)
        found.append((bare, following[bare], np.full(len(bare), -1, np.int32)))
        which, to, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return start[which] + text[which], to + text[which], piece

    def sample(self, u: np.ndarray, at: np.ndarray, which: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a segmentation for each occurrence (text of u, key of its numbers): piece ids in order and their counts."""
        start, end, piece = self.edges(u, at)
        lengths = np.diff(at)
        origin = at[:-1] + np.arange(len(lengths))
        weight = np.where(piece >= 0, self.logp[piece], self.fallback)
        owner_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        order = np.argsort(end, kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        level = end - origin[owner_of[end]]
        order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        start_, end_, weight_, level_ = start[order], end[order], weight[order], level[order]
        alpha = np.full(len(u) + len(lengths), -np.inf)
        alpha[origin] = 0
        cut = np.flatnonzero(np.diff(level_, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(level_)], strict=True):
            value = alpha[start_[a:b]] + weight_[a:b]
            first = np.flatnonzero(np.diff(end_[a:b], prepend=-1))
            alpha[end_[a:b][first]] = np.logaddexp.reduceat(value, first)
        total = np.cumsum(np.exp(alpha[start] + weight - alpha[end]))
        first = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(alpha)))])
        total0 = np.concatenate([[0.0], total])
        place = origin[which] + lengths[which]
        row, steps = np.arange(len(which)), []
        count = np.zeros(len(which), np.int64)
        while len(row):
            edge, high = first[place], first[place + 1] - 1
            draw = mix(key[row] + np.uint64(len(steps) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            want = total0[edge] + (draw >> np.uint64(11)).astype(np.float64) / (1 << 53) * (total0[high + 1] - total0[edge])
            walk = np.flatnonzero((edge < high) & (total[edge] <= want))
            while len(walk):
                edge[walk] += 1
                walk = walk[(edge[walk] < high[walk]) & (total[edge[walk]] <= want[walk])]
            steps.append((row, edge))
            count[row] += 1
            place = start[edge]
            more = place > origin[which[row]]
            row, place = row[more], place[more]
        out = np.zeros(count.sum(), np.int64)
        until = np.cumsum(count)
        for k, (row, edge) in enumerate(steps):
            out[until[row] - 1 - k] = edge
        # byte pieces: one id for each byte of the character
        ids = piece[out]
        bare = ids < 0
        width = np.where(bare, end[out] - start[out], 1)
        many = np.repeat(ids, width)
        if bare.any():
            byte0 = start[out[bare]] - owner_of[start[out[bare]]]
            w = width[bare]
            inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            many[many < 0] = self.bytes[u[np.repeat(byte0, w) + inner]]
        per = np.add.reduceat(width, until - count) if len(count) else count
        return many, per

    def encode(self, data: np.ndarray, at: np.ndarray, key: np.ndarray, share: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each one's. share: distinct words are told apart by a 64-bit hash."""
        filled = np.flatnonzero(np.diff(at) > 0)
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        marked = np.insert(data, at[filled], 32)  # the word mark in front
        bounds = np.concatenate([at[filled] + np.arange(len(filled)), [len(marked)]])
        gap, line = marked == 32, marked == 10
        begin = line.copy()
        begin[1:] |= line[:-1] | (gap[1:] & ~gap[:-1])
        begin[bounds[:-1]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(marked)))
        text = np.searchsorted(bounds, starts, side="right") - 1
        ordinal = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[text]
        if share:
            _, one, which = np.unique(segment_hash(marked, starts, np.ones(len(marked), bool)), return_index=True, return_inverse=True)
        else:
            one = which = np.arange(len(starts))
        size = lengths[one]
        offsets = np.concatenate([[0], np.cumsum(size)])
        u = marked[np.repeat(starts[one] - offsets[:-1], size) + np.arange(offsets[-1])]
        order = np.argsort(which, kind="stable")  # neighbours read the same part of the tables
        numbers = mix(key[filled][text].astype(np.uint64) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, per = self.sample(u, offsets, which[order], numbers[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(per) - per
        count = np.empty(len(order), np.int64)
        count[order] = per
        total = np.concatenate([[0], np.cumsum(count)])
        ids = ids[np.repeat(back - total[:-1], count) + np.arange(total[-1])]
        n = np.zeros(len(at) - 1, np.int64)
        n[filled] = np.add.reduceat(count, np.searchsorted(starts, bounds[:-1]))
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of id lists: bytes and offsets. The word mark in front of a text is taken off again."""
        width = self.width[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        data = self.pool[np.repeat(self.from_[ids] - total[:-1], width) + np.arange(total[-1])]
        at = total[offsets]
        marked = at[:-1][np.diff(at) > 0]
        marked = marked[data[marked] == 32]
        drop = np.zeros(len(data) + 1, np.int64)
        drop[marked + 1] = 1
        keep = np.ones(len(data), bool)
        keep[marked] = False
        return data[keep], at - np.cumsum(drop)[at]


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(vocabulary_of, theta: float) -> Lattice:
    """The one that a Python worker keeps, of the model and theta in use."""
    key = (vocabulary_of.value.path, theta)
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(vocabulary_of.value, theta)
    return _lattices[key]


def _encode_kernel(vocabulary_of, theta: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tool = lattice(vocabulary_of, theta)
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES // 8):
                data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
                key = np.asarray(batch.column(batch.schema.get_field_index("__key")), np.int64).view(np.uint64)
                ids, offsets = tool.encode(data, at, key)
                back, back_at = tool.decode(ids, offsets)
                if not (np.array_equal(back_at, at) and np.array_equal(back, data)):
                    ids, offsets = tool.encode(data, at, key, share=False)  # two words with one hash
                    back, back_at = tool.decode(ids, offsets)
                same = np.diff(at) == np.diff(back_at)
                if not (np.array_equal(back_at, at) and np.array_equal(back, data)):
                    same &= [np.array_equal(data[at[k] : at[k + 1]], back[back_at[k] : back_at[k + 1]]) for k in range(len(same))]
                missing = batch.column(batch.schema.get_field_index("text")).is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=missing) if missing.true_count else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                own = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != "__key"]
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(np.diff(offsets)), pa.array(same)], names)

    return run


def sampled(df: DataFrame, *, key: str = "doc_id", model: str = MODEL, theta: float = 0.3, seed: int = 1) -> DataFrame:
    """df with piece_ids (array<int>), n_pieces and lossless (decoding gave the bytes of the text back) added.

    theta: 0 draws all segmentations alike, large values the most probable one. A null text has null ids (no pieces),
    an empty one no ids. Rows with equal key and text are segmented alike; a null key is a key like any other. Texts of
    any length are taken whole, in memory of the order of the longest one.
    """
    df = df.drop("piece_ids", "n_pieces", "lossless")
    vocabulary_of = df.sparkSession.sparkContext.broadcast(Vocabulary(model))  # the size of the model file
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "piece_ids array<int>", "n_pieces long", "lossless boolean"])
    names = [*df.columns, "piece_ids", "n_pieces", "lossless"]
    return df.withColumn("__key", F.xxhash64(F.lit(seed), key)).mapInArrow(_encode_kernel(vocabulary_of, theta, names), schema)


def decoded(df: DataFrame, *, ids: str = "piece_ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of each list of ids in column `into` (null for null). Ids must be of the model."""
    df = df.drop(into) if into != ids else df
    vocabulary_of = df.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(vocabulary_of, 1.0)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            flat = np.asarray(col.flatten(), np.int64)
            n = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
            data, at = tool.decode(flat, np.concatenate([[0], np.cumsum(n)]))
            texts = [None if not v.is_valid else data[a:b].tobytes().decode("utf-8", "replace") for v, a, b in zip(col, at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{into}` string"])
    return df.mapInArrow(run, schema)
