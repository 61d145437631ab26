"""Suffix-array dedup: shards' Burrows-Wheeler transforms are merged by iterative interleave refinement.

A byte goes when a string of LENGTH bytes that covers it also starts in a document of a smaller id. Strings are dealt by
their minimizer (the least hash of their K-byte parts): equal strings have the same one, so all that can be equal meets
in one part, and a run of strings with one minimizer travels as one stretch of text. Minimizers that only one document
has are left out before (a keyed lookup); they can't repeat.

The strings of a minimizer that many different stretches have (a common phrase in ever other surroundings) are dealt one by
one, by their own hash: a block sends each of them once, whatever surrounds it, so no part gets more of one than there
are blocks.

A part puts the stretches of each minimizer together. Where they all read the same there is nothing to merge. The others are
dealt into shards; each shard's suffixes are sorted once and give its transform. The shards are merged without
sorting suffixes again: the interleave (which shard the next suffix is from) starts shard by shard, and each round
passes it through the transforms, as a stable sort by one symbol, so that after h rounds it is in order of the first h
symbols. An interval of round h has a common prefix of h symbols; those of round LENGTH are the repeated strings, and
each takes the least id of its documents. A round only moves the suffixes from which LENGTH symbols back a string
begins; all others lead nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, CHUNK_BYTES, mix, pieces, powers, release, text_buffer
from .exchange import REPLY, answers, ask, blocks, gathered, packed, partitions_for, replies, split, together, unpacked

LENGTH, K = 50, 20
#: The strings of a minimizer with more different stretches than this are dealt one by one.
HOT = 2000
#: Strings in a stretch at most. Two stretches of one hash would need texts of 1024 bytes made for it.
LONGEST = 512
#: Strings are merged in batches of about so many bytes (what a cache holds), whole minimizers each.
BATCH = 1 << 16
CODEC = pa.Codec("zstd")
#: Bytes of text that are worked on at once; a longer text is taken whole.
CHUNK = CHUNK_BYTES // 2
#: Bytes of a shard.
SHARD = 1 << 12
LAST = np.iinfo(np.int64).max


def _inverse(n: int) -> np.ndarray:
    inverse = pow(int(BASE), -1, 1 << 64)
    factors = np.full(n, inverse, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


_back = np.ones(1, np.uint64)


class Prefix:
    """Hashes of any stretch of a text run, from prefix sums."""

    def __init__(self, data: np.ndarray):
        global _back
        if len(_back) < len(data) + 1:
            _back = _inverse(max(len(data) + 1, CHUNK + 4096))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * _back[start])


def _least(h: np.ndarray) -> np.ndarray:
    """The least of every LENGTH - K + 1 numbers in a row."""
    width, have = LENGTH - K + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :])


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def stretches(data: np.ndarray, at: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of strings with one minimizer: first string's start, number of strings, minimizer, text, hash of the bytes, and
    the key they are dealt by (other than the minimizer where it is among the hot ones)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = Prefix(data)
    start = np.arange(n - K + 1)
    h = hashed(start, start + K)
    m = _least(h)
    key = m
    if hot is not None and len(hot) and (split_ := _among(m, hot)).any():
        at_ = np.flatnonzero(split_)
        key = m.copy()
        key[at_] = mix(m[at_] * np.uint64(31) + hashed(at_, at_ + LENGTH))  # of the string alone, so that every block has the same one
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(m)]
    valid = np.arange(len(m)) + LENGTH <= at[text + 1]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    # a run ends where the next one begins, or with its text's last string
    bound = np.flatnonzero(new | ~valid)
    after = np.append(bound, len(m))[np.searchsorted(bound, first, side="right")]
    if len(first) and (after - first).max() > LONGEST:
        n_cuts = -(-(after - first) // LONGEST)
        nth = np.arange(n_cuts.sum()) - np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts)
        first, after = np.repeat(first, n_cuts) + nth * LONGEST, np.repeat(after, n_cuts)
        after = np.minimum(after, first + LONGEST)
    return first, after - first, m[first], text[first], hashed(first, after + LENGTH - 1), key[first]


def _suffixes(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of a shard's suffixes by their first LENGTH symbols. left: symbols up to the end sign of the string."""
    n = len(symbols)
    room = np.zeros(n + LENGTH, np.uint8)
    room[:n] = symbols
    heads = np.lib.stride_tricks.sliding_window_view(room, LENGTH)[:n].copy()
    cut = np.flatnonzero(left < LENGTH)
    heads[cut] *= np.arange(LENGTH) < left[cut, None]
    return np.argsort(heads.view(f"S{LENGTH}")[:, 0], kind="stable")


def merged_least(pool: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Strings (one after the other in pool) with the least document id of each. For each place of pool at which LENGTH
    bytes of its string begin: the least id among the places that read the same; other places: LAST."""
    used = np.zeros(256, bool)
    used[pool] = True
    if used.sum() > 255:
        raise ValueError("texts with all 256 bytes aren't UTF-8")
    symbol_of = np.zeros(256, np.uint8)
    symbol_of[used] = np.arange(1, used.sum() + 1)
    strings = len(size)
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    total = int(ends[-1])
    symbols = np.zeros(total, np.uint8)  # 0: the end sign
    inside = np.arange(len(pool)) + np.repeat(np.arange(strings), size)
    symbols[inside] = symbol_of[pool]
    string = np.repeat(np.arange(strings), size + 1)
    left = ends[string] - 1 - np.arange(total)
    shard_of = (np.cumsum(size + 1) - 1) // SHARD
    shard_of = np.unique(shard_of, return_inverse=True)[1]
    cut = np.append(np.searchsorted(shard_of, np.arange(shard_of[-1] + 1)), strings)
    suffix, transform = np.empty(total, np.int64), np.empty(total, np.uint8)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = begin[a], ends[b - 1]
        order = _suffixes(symbols[lo:hi], left[lo:hi]) + lo
        tails = ends[a:b] - 1
        order = np.concatenate([tails, order[symbols[order] != 0]])  # end signs in order of their strings
        suffix[lo:hi] = order
        before = symbols[np.maximum(order - 1, 0)]
        before[begin[string[order]] == order] = 0
        transform[lo:hi] = before
    # the interleave as places in the shards' transforms, shard by shard at first. Only places from which the beginning of a
    # string of LENGTH symbols is reached take part: h symbols before it ends in round h, so all of them arrive together
    kind = np.int32 if total < 1 << 31 else np.int64
    place = np.empty(total, kind)
    place[suffix] = np.arange(total, dtype=kind)
    before_of = place.take(suffix - 1, mode="wrap")  # the place of the suffix that is a symbol longer
    inter = np.sort(place[np.flatnonzero(left >= LENGTH) + LENGTH])
    interval = np.zeros(len(inter), kind)
    new = np.ones(len(inter), bool)
    for _ in range(LENGTH):
        s = transform.take(inter)
        order = np.argsort(s, kind="stable")
        sign, old = s.take(order), interval.take(order)
        np.not_equal(sign[1:], sign[:-1], out=new[1:])
        new[1:] |= old[1:] != old[:-1]
        inter = before_of.take(inter.take(order))
        interval = np.cumsum(new, dtype=kind)
    where = suffix[inter]
    out = np.full(total, LAST)
    if not len(where):
        return out[inside]
    own = owner[string[where]]
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    out[where] = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
    return out[inside]


def _chunks(table: pa.Table) -> Iterator[tuple]:
    for whole in table.combine_chunks().to_batches():
        for batch in pieces(whole, "text", CHUNK):
            data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield batch, data, at, np.asarray(ids.fill_null(LAST), np.int64)


def _minimizers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's minimizers; whether more than one of its documents has it, and how many stretches."""
    keys, low, high, many = [], [], [], []
    for _, data, at, ids in _chunks(table):
        _, _, m, text, h, _ = stretches(data, at)
        k, i = np.unique(m, return_inverse=True)
        lo, hi = np.full(len(k), LAST), np.full(len(k), np.iinfo(np.int64).min)
        np.minimum.at(lo, i, ids[text])
        np.maximum.at(hi, i, ids[text])
        _, one = np.unique(h, return_index=True)
        keys.append(k)
        low.append(lo)
        high.append(hi)
        many.append(np.bincount(i[one], minlength=len(k)))
    keys, low, high, many = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, low, high, many))
    k, i = together(keys)
    lo, hi = np.full(len(k), LAST), np.full(len(k), np.iinfo(np.int64).min)
    np.minimum.at(lo, i, low.astype(np.int64))
    np.maximum.at(hi, i, high.astype(np.int64))
    n = np.minimum(np.bincount(i, many, len(k)), 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return k, np.concatenate([(lo != hi).astype(np.uint8)[:, None], n], axis=1)


FIELDS = ("minimizer", "size", "owner", "pool", "hot")
STRETCH = "part int, block int, " + ", ".join(f"{x} binary" for x in FIELDS)


def _distinct(table: pa.Table, found: list, keys: np.ndarray, shared: np.ndarray, n_parts: int) -> pa.Table:
    """A block's distinct stretches of shared minimizers, with the least id that has each, for the parts. found: its chunks
    and their stretches."""
    hot = keys[shared == 2]
    m_, size_, owner_, pool_, hot_ = [], [], [], [], []
    for data, at, ids, runs in found:
        first, many, m, text, h, key = stretches(data, at, hot) if _among(runs[2], hot).any() else runs
        keep = shared[np.searchsorted(keys, m)] > 0
        first, many, m, text, h, key = (x[keep] for x in (first, many, m, text, h, key))
        if not len(first):
            continue
        order = np.lexsort((ids[text], h))
        one = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]
        size = many[one] + LENGTH - 1
        at_ = np.cumsum(size) - size
        m_.append(key[one])
        hot_.append(np.where(key[one] != m[one], m[one], np.uint64(0)))
        size_.append(size)
        owner_.append(ids[text[one]])
        pool_.append(data[np.repeat(first[one] - at_, size) + np.arange(size.sum())])
    if not m_:
        return pa.schema([("part", pa.int32()), ("block", pa.int32()), *((x, pa.binary()) for x in FIELDS)]).empty_table()
    m, size, owner, pool, hot = (np.concatenate(x) for x in (m_, size_, owner_, pool_, hot_))
    begin = np.cumsum(size) - size
    order, cut = split(m, n_parts)
    has = np.flatnonzero(np.diff(cut))
    rows = {x: [] for x in FIELDS}
    for k in has:
        own = order[cut[k] : cut[k + 1]]
        own = own[np.argsort(m[own], kind="stable")]
        w = size[own]
        rows["minimizer"].append(packed(m[own]))
        rows["hot"].append(packed(np.unique(hot[own][hot[own] > 0])))  # told back to the block with the answers
        rows["size"].append(packed(w.astype("<i4")))
        rows["owner"].append(packed(owner[own]))
        rows["pool"].append(CODEC.compress(pool[np.repeat(begin[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())].tobytes(), asbytes=True))
    return pa.table({"part": pa.array(has, pa.int32()), "block": pa.array(np.full(len(has), table["block"][0].as_py()), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in rows.items()}})


LEAST = "block int, hash binary, runs binary, length binary, value binary, hot binary"


def _batches(size: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole groups of about BATCH bytes."""
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    upto = np.concatenate([[0], np.cumsum(size)])[np.append(heads, len(size))]
    out, a = [], 0
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + BATCH)))
        b = min(b, len(heads))
        out.append((int(heads[a]), int(heads[b]) if b < len(heads) else len(size)))
        a = b
    return out


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return pool[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _names(pool: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each stretch, as its block has it."""
    out, begin = np.empty(len(size), np.uint64), np.cumsum(size) - size
    for a, b in _batches(size, np.arange(len(size))):
        own = Prefix(pool[begin[a] : begin[b - 1] + size[b - 1]])
        start = begin[a:b] - begin[a]
        out[a:b] = own(start, start + size[a:b])
    return out


def _runs(strings: np.ndarray, w: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of merged strings: number of runs of equal least ids in each, the runs' lengths and ids."""
    at = np.cumsum(w) - w
    least = merged_least(strings, w, owner)
    begins = np.arange(len(least)) - np.repeat(at, w) <= np.repeat(w, w) - LENGTH
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[at] = True
    head = np.flatnonzero(change & begins)
    which = np.searchsorted(at, head, side="right") - 1
    stop = np.append(head[1:], len(least))
    last = np.append(which[1:] != which[:-1], True)
    stop[last] = (at + w - LENGTH + 1)[which[last]]
    return np.bincount(which, minlength=len(w)), stop - head, least[head]


def _intervals(table: pa.Table) -> pa.Table:
    """A part: each stretch's strings with the least id that has them, as runs of equal ids, for the blocks that asked."""
    release()
    table = table.combine_chunks()
    owners = table["block"].to_pylist()
    column = lambda name, kind: [unpacked(x.as_py(), np.dtype(kind).itemsize).view(kind)[:, 0] for x in table[name]]
    m_, size_ = column("minimizer", "<u8"), column("size", "<i4")
    counts = [len(x) for x in m_]
    m, size, owner = np.concatenate(m_), np.concatenate(size_).astype(np.int64), np.concatenate(column("owner", "<i8"))
    pool = np.concatenate([np.frombuffer(CODEC.decompress(x.as_py(), decompressed_size=int(n.sum()), asbytes=True), np.uint8) for x, n in zip(table["pool"], size_, strict=True)])
    h = _names(pool, size)
    begin = np.cumsum(size) - size
    order = np.lexsort((owner, h, m))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (m[order][1:] != m[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    one = order[new]  # the least owner of each distinct stretch
    fresh = np.ones(len(one), bool)
    fresh[1:] = m[one][1:] != m[one][:-1]
    group = np.cumsum(fresh) - 1
    several = np.bincount(group)[group] > 1
    runs, length, value = np.ones(len(one), np.int64), size[one] - LENGTH + 1, owner[one].copy()
    if several.any():
        mine = one[several]
        done = [_runs(_gather(pool, begin[mine[a:b]], size[mine[a:b]]), size[mine[a:b]], owner[mine[a:b]]) for a, b in _batches(size[mine], group[several])]
        runs[several] = np.concatenate([x[0] for x in done])
        every = np.repeat(several, runs)
        flat_length, flat_value = np.empty(runs.sum(), np.int64), np.empty(runs.sum(), np.int64)
        flat_length[every], flat_value[every] = np.concatenate([x[1] for x in done]), np.concatenate([x[2] for x in done])
        flat_length[~every], flat_value[~every] = length[~several], value[~several]
        length, value = flat_length, flat_value
    run_at = np.cumsum(runs) - runs
    cut = np.concatenate([[0], np.cumsum(counts)])
    out = {"runs": [], "length": [], "value": [], "hash": []}
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        r = runs[inverse[a:b]]
        flat = np.repeat(run_at[inverse[a:b]] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        out["hash"].append(packed(h[a:b]))
        out["runs"].append(packed(r.astype("<i4")))
        out["length"].append(packed(length[flat].astype("<i4")))
        out["value"].append(packed(value[flat]))
    return pa.table({"block": pa.array(owners, pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("hash", "runs", "length", "value")}, "hot": table["hot"]})


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def _apply(with_text: bool):
    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        got = got.combine_chunks()
        column = lambda name, kind: np.concatenate([unpacked(x.as_py(), np.dtype(kind).itemsize).view(kind)[:, 0] for x in got[name]]) if got.num_rows else np.zeros(0, kind)
        h, runs, length, value = column("hash", "<u8"), column("runs", "<i4").astype(np.int64), column("length", "<i4").astype(np.int64), column("value", "<i8")
        run_at = np.cumsum(runs) - runs
        order = np.argsort(h, kind="stable")
        known = h[order]
        hot = np.unique(column("hot", "<u8"))
        done = []
        for batch, data, at, ids in _chunks(table):
            first, _, _, text, mine, _ = stretches(data, at, hot)
            edge = np.zeros(len(data) + 1, np.int64)
            if len(known) and len(first):
                i = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[i] == mine
                row, first, text = order[i[hit]], first[hit], text[hit]
                r = runs[row]
                flat = np.repeat(run_at[row] - (np.cumsum(r) - r), r) + np.arange(r.sum())
                n = length[flat]
                upto = np.cumsum(n) - n
                start = np.repeat(first - upto[np.cumsum(r) - r], r) + upto
                gone = value[flat] < ids[np.repeat(text, r)]
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, start[gone] + n[gone] + LENGTH - 1, -1)
            removed = np.cumsum(edge[:-1]) > 0
            where = np.concatenate([[0], np.cumsum(removed)])
            opens = removed.copy()
            opens[1:] &= ~removed[:-1]
            inner = at[:-1][np.diff(at) > 0]
            opens[inner] = removed[inner]  # a run never spans two documents
            spans = np.concatenate([[0], np.cumsum(opens)])
            kept = [data[a:b][~removed[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            done.append(pa.table([
                batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(np.diff(at)), pa.array(where[at[1:]] - where[at[:-1]]), pa.array(spans[at[1:]] - spans[at[:-1]]),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if with_text else [None] * len(kept), pa.binary()),
            ], schema=RESULT))
        return pa.concat_tables(done) if done else RESULT.empty_table()

    return run


def deduped(docs: DataFrame, *, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (the remaining bytes, if asked for).

    A null text is an empty one. Rows of one id don't remove each other's bytes; rows without an id come after all
    others and don't remove each other's. Texts of fewer than LENGTH bytes keep all. Extra columns are ignored; an empty
    table gives no rows. Repeated rows are answered alike.
    """
    docs = docs.select("doc_id", "text")
    n = partitions_for(docs)
    blk = blocks(docs, F.xxhash64("doc_id", "text"), n)

    def minimizers(table: pa.Table) -> pa.Table:
        release()
        return ask(table["block"][0].as_py(), *_minimizers(table), n)

    def shared(table: pa.Table) -> pa.Table:
        """0: one document has it; 1: several; 2: several, in many different stretches."""
        owners, keys, share, at = gathered(table, 3)
        k, i = together(keys)
        both = (np.bincount(i, minlength=len(k)) > 1) | (np.bincount(i, share[:, 0], len(k)) > 0)
        many = np.bincount(i, share[:, 1:].copy().view("<u2")[:, 0], len(k)) > hot
        return replies(table["part"][0].as_py(), owners, (both.astype(np.uint8) + (both & many))[i], at)

    def send(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        found = [(data, at, ids, stretches(data, at)) for _, data, at, ids in _chunks(table)]
        keys = np.unique(np.concatenate([r[2] for *_, r in found])) if found else np.zeros(0, np.uint64)
        return _distinct(table, found, keys, answers(keys, n, got, np.uint8), n)

    asked = blk.groupBy("block").applyInArrow(minimizers, "part int, block int, keys binary, shares binary")
    told = asked.repartition(n, "part").groupBy("part").applyInArrow(shared, REPLY)
    sent = blk.groupBy("block").cogroup(told.repartition(n, "block").groupBy("block")).applyInArrow(send, STRETCH)
    least = sent.repartition(n, "part").groupBy("part").applyInArrow(_intervals, LEAST)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    return blk.groupBy("block").cogroup(least.repartition(n, "block").groupBy("block")).applyInArrow(_apply(with_text), schema)


