"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A shingle is `shingle` words in a row. Its weight in a document is (1 + ln tf) * idf with
idf = 1 + spread * (1 - ln(max(1, df / RARE)) / ln(N)): df counts the documents that have it, over the whole table, rounded
down to half a power of two. Up to RARE documents a shingle is as good as unique, and spread keeps idf between 1 and
1 + spread, so that a text copied thousands of times still matches its edited copies. Two samples of two documents agree with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, mix, release_now_and_then, text_buffer, windows, written
from .exchange import blocks, lookup, partitions_for
from .graph import components, join_pairs

BANDS, ROWS = 10, 3
#: In so many documents at most a shingle has the full idf.
RARE = 32
#: Entries of the tables of Gamma(2, 1) variates that the samples draw from.
TABLE = 1 << 14
#: Shingles that a sampling pass holds at once (whole documents, one at least).
PASS = 1 << 17
#: Document frequencies are counted by 48 bits of a shingle's hash; a chance meeting adds a document to the count.
KEY = np.uint64((1 << 48) - 1)
#: A bucket of more texts, or with more shingles, is cut into blocks, which meet in pairs.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Texts that a leader meets at once.
LEAD = 256
#: Steps of the distance to a leader.
CELLS = 20
#: Hash places by which texts that are no candidates are left out before the exact join; a bound on what is broadcast.
PLACES = 1 << 18


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle; a text of fewer words, but one at least, is one shingle."""
    w = Words(data, at)
    i, h = windows(w, n)
    text = w.text[i]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        fold = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            fold[has] = mix(fold[has] * np.uint64(31) + w.hash[w.first[short[has]] + k] + np.uint64(k + 1))
        text, h = np.concatenate([text, short]), np.concatenate([h, fold])
    return text, h


def counted(text: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order of text and hash: hash, tf, and where each text's begin."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    return h[first], tf, np.searchsorted(text[first], np.arange(n_texts + 1))


def code_of(df: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(df, 1))).astype(np.uint8)


def weights(tf: np.ndarray, code: np.ndarray, n_docs: int, spread: float) -> np.ndarray:
    share = np.maximum(0.0, code * (np.log(2) / 2) - np.log(RARE)) / np.log(n_docs) if n_docs > 1 else np.zeros(len(code))
    return (1 + np.log(tf)) * (1 + spread * np.maximum(0.0, 1 - share))


_tables: list[np.ndarray] = []


def _gamma() -> list[np.ndarray]:
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(12345))
        for _ in range(2):
            _tables.append(-np.log(rng.random(TABLE)) - np.log(rng.random(TABLE)))
        _tables[1] = np.log(_tables[1])
    return _tables


def samples(h: np.ndarray, weight: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text (rows: texts with shingles), as 64-bit names of shingle and level."""
    r_of, lnc_of = _gamma()
    has = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, n), np.uint64)
    k = 0
    while k < len(has):
        stop = max(k + 1, int(np.searchsorted(at[has], at[has[k]] + PASS)))
        own = has[k:stop]
        lo, hi = at[own[0]], at[own[-1] + 1]
        x, lnw, first = h[lo:hi], np.log(weight[lo:hi]), at[own] - lo
        counts = np.diff(np.append(first, hi - lo))
        for j in range(n):
            g = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            r = r_of[(g & np.uint64(TABLE - 1)).astype(np.int32)]
            beta = ((g >> np.uint64(28)) & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
            t = np.floor(lnw / r + beta)
            a = lnc_of[((g >> np.uint64(14)) & np.uint64(TABLE - 1)).astype(np.int32)] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, first)
            hit = np.flatnonzero(a == np.repeat(least, counts))
            owner = np.searchsorted(first, hit, side="right") - 1
            hit = hit[np.diff(owner, prepend=-1) > 0]  # ties: the first in order of hash
            out[own, j] = mix(x[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        k = stop
    return out


def band_keys(names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(names), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(names), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(31) + names[:, b * ROWS + r])
        out[:, b] = key
    return out


def text_hashes() -> dict:
    """Two hashes that stand for a text."""
    return {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(2), "text")}


def _chunks(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    from .common import pieces

    for whole in table.combine_chunks().to_batches():
        for batch in pieces(whole, "text", CHUNK_BYTES):
            yield batch, *text_buffer(batch.column(batch.schema.get_field_index("text")))


def signatures(docs: DataFrame, n_docs: int, shingle: int, spread: float) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), bands, codes (a byte of idf for each distinct shingle, in order of hash)."""

    def request(table: pa.Table, again: bool) -> tuple[np.ndarray, np.ndarray, list]:
        kept, found = [], []
        for batch, data, at in _chunks(table):
            h, tf, of = counted(*shingles(data, at, shingle), len(at) - 1)
            found.append(h & KEY)
            kept += [(batch, h, tf, of)] * again
        keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
        return keys, n.astype("<u4").view(np.uint8).reshape(-1, 4), kept

    def answer(distinct: np.ndarray, inverse: np.ndarray, shares: np.ndarray) -> np.ndarray:
        df = np.bincount(inverse, shares.copy().view("<u4")[:, 0], len(distinct))
        return code_of(df)[inverse]

    def apply(keys: np.ndarray, code: np.ndarray, kept: list) -> pa.Table:
        rows = []
        for batch, h, tf, of in kept:
            c = code[np.searchsorted(keys, h & KEY)]
            names = band_keys(samples(h, weights(tf, c, n_docs, spread), of, BANDS * ROWS))
            filled = np.diff(of) > 0
            bands = [x.astype(np.int64) if f else None for x, f in zip(names.view(np.int64), filled, strict=True)]
            codes = [c[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            own = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "h1", "h2")}
            del batch, h, tf, of, c, names
            rows.append(pa.table({**own, "bands": pa.array(bands, pa.list_(pa.int64())), "codes": pa.array(codes, pa.binary())}))
        kept.clear()  # before the memory is given back
        schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("codes", pa.binary())])
        return pa.concat_tables([t.cast(schema) for t in rows]) if rows else schema.empty_table()

    n = partitions_for(docs)
    blk = blocks(docs.withColumns(text_hashes()), F.xxhash64("doc_id", "text"), n)
    return lookup(blk, request, answer, apply, "doc_id long, h1 long, h2 long, bands array<long>, codes binary", n=n, width=4, dtype=np.uint8)


def _lead_kernel(n_docs: int, shingle: int, spread: float):
    """A leader's text with some texts of its buckets: their weighted Jaccard similarities."""

    def run(table: pa.Table) -> pa.Table:
        release_now_and_then()
        lead, ids = table["lead"][0].as_py(), np.asarray(table["id"], np.int64)
        k = int(np.flatnonzero(ids == lead)[0])
        data, at = text_buffer(table["text"])
        h, tf, of = counted(*shingles(data, at, shingle), len(ids))
        w = weights(tf, np.frombuffer(b"".join(x.as_py() for x in table["codes"]), np.uint8), n_docs, spread)
        own, own_w = h[of[k] : of[k + 1]], w[of[k] : of[k + 1]]
        i = np.minimum(np.searchsorted(own, h), len(own) - 1)
        both = np.add.reduceat(np.where(own[i] == h, np.minimum(w, own_w[i]), 0.0), of[:-1])
        total = np.add.reduceat(w, of[:-1])
        rest = np.flatnonzero(ids != lead)
        return pa.table({"a": np.full(len(rest), lead), "b": ids[rest], "s": (both / (total + total[k] - both))[rest]})

    return run


def candidates(docs: DataFrame, sig: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, codes, bands of the texts that share a bucket with others."""
    ids = reps.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "h1", "h2", "bands")
    place = lambda c: F.pmod(F.xxhash64(F.lit(5), c), F.lit(PLACES)).cast("int")
    near = F.broadcast(ids.select(place("doc_id").alias("place")).distinct())  # PLACES integers at most
    keys = ["doc_id", "h1", "h2"]
    texts = docs.where("doc_id is not null").withColumn("place", place("doc_id")).join(near, "place", "left_semi").drop("place")
    texts = texts.withColumns(text_hashes()).join(ids, keys).dropDuplicates(keys)
    codes = sig.where("doc_id is not null").select(*keys, "codes").join(ids.select(*keys), keys, "left_semi").dropDuplicates(keys)
    return texts.join(codes, keys).select("node", "text", "codes", "bands")


def compared_to_leaders(members: DataFrame, full: DataFrame, n_docs: int, shingle: int, spread: float) -> DataFrame:
    """a (leader), b (member of one of its buckets), s (similarity). A leader of many texts meets them in several groups."""
    edges = members.select("lead", F.col("node").alias("id"), "width").distinct()
    many = edges.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / LEAD), F.ceil(F.sum("width") / BLOCK_SHINGLES)).cast("int").alias("splits"))
    dealt = edges.join(many, "lead").select("lead", "id", F.pmod(F.xxhash64(F.lit(15), "id"), F.col("splits")).cast("int").alias("salt"))
    own = many.select("lead", F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    rows = dealt.unionByName(own).join(full.select(F.col("node").alias("id"), "text", "codes"), "id")
    return rows.groupBy("lead", "salt").applyInArrow(_lead_kernel(n_docs, shingle, spread), "a long, b long, s double")


def unresolved(members: DataFrame, found: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """key, node, part, lo, hi, first: members of the buckets (without their leaders) that may have a similar text of another
    part (component so far), dealt into blocks; two blocks of a bucket meet once, `first` tells the one from the other.

    1 - similarity is a metric, so two similar texts are about equally far from their leader: within 1 - threshold. A text
    that has none of another part within that is settled.
    """
    known = found.select(F.col("a").alias("lead"), F.col("b").alias("node"), F.floor((1 - F.col("s")) * CELLS).cast("int").alias("cell"))
    parts = linked.select("node", F.col("component").alias("part"))
    named = members.join(known, ["lead", "node"]).join(parts, "node", "left").select("key", "node", "width", "cell", F.coalesce("part", "node").alias("part"))
    cells = named.groupBy("key", "cell").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    reach = int(np.ceil((1 - threshold) * CELLS)) + 1
    around = Window.partitionBy("key").orderBy("cell").rangeBetween(-reach, reach)  # CELLS + 1 rows of a bucket
    mixed = cells.select("key", "cell", F.min("p").over(around).alias("p"), F.max("q").over(around).alias("q")).where("p < q")
    left = named.join(mixed, ["key", "cell"]).select("key", "node", "width", "part")
    splits = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("width") / BLOCK_SHINGLES)).cast("int").alias("splits"))
    dealt = left.join(splits, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(14), "node"), F.col("splits")).cast("int"))
    met = dealt.select("key", "node", "part", "own", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("other"))
    return met.select("key", "node", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("first"))


def _block_kernel(n_docs: int, shingle: int, spread: float, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        release_now_and_then()
        node, part = np.asarray(table["node"], np.int64), np.asarray(table["part"], np.int64)
        n, same = len(node), table["lo"][0].as_py() == table["hi"][0].as_py()
        side = np.asarray(table["first"].to_numpy(), bool)
        root = np.unique(part, return_inverse=True)[1]
        root = np.unique(root, return_index=True)[1][root]  # a member of each part
        if root.max() == root.min():
            return table.select(["node", "part"]).slice(0, 0).rename_columns(["a", "b"])
        bands = np.asarray(table["bands"].combine_chunks().flatten(), np.int64).reshape(n, -1)
        band = int(np.flatnonzero((bands == table["key"][0].as_py()).all(0))[0])
        data, at = text_buffer(table["text"])
        h, tf, of = counted(*shingles(data, at, shingle), n)
        code = np.frombuffer(b"".join(x.as_py() for x in table["codes"]), np.uint8)
        w = weights(tf, code, n_docs, spread)
        names, column = np.unique(h, return_inverse=True)
        total = np.add.reduceat(w, of[:-1])
        dense, size, start = np.zeros(len(names)), np.diff(of), root.copy()
        for x in np.flatnonzero(side):
            near = root != root[x]
            near[: x + 1] &= not same
            near &= ~side | same
            near &= np.minimum(total, total[x]) >= (threshold - 1e-9) * np.maximum(total, total[x])
            y = np.flatnonzero(near)
            y = y[~(bands[y, :band] == bands[x, :band]).any(1)]  # a pair is compared in the first of its buckets
            if not len(y):
                continue
            own = slice(of[x], of[x + 1])
            dense[column[own]] = w[own]
            for k in range(0, len(y), 256):
                z = y[k : k + 256]
                begin = np.cumsum(size[z]) - size[z]
                flat = np.repeat(of[z] - begin, size[z]) + np.arange(size[z].sum())
                both = np.add.reduceat(np.minimum(dense[column[flat]], w[flat]), begin)
                z = z[both / (total[x] + total[z] - both) >= threshold - 1e-9]
                if len(z):
                    join_pairs(root, np.full(len(z), x), z)
            dense[column[own]] = 0
        hit = np.flatnonzero((start == np.arange(n)) & (root != start))
        return pa.table({"a": node[root[hit]], "b": node[hit]})

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, spread: float = 0.25, hashes: bool = False) -> DataFrame:
    """One row per document: doc_id, rep_id (least id with the same text), component_id (least id that links of a weighted
    similarity of `threshold` or more reach), kept (the document whose id is its component's).

    Candidates share a band of samples. In a bucket every text is held against the least one; then all pairs of the others
    that no links connect so far and that may be similar are compared, in blocks that meet in pairs. Null texts and texts
    without words are alone. Rows that share id and text are one document; rows that share the id only are judged each
    by its text. Rows without an id are alone (component null, kept). Extra columns are ignored; an empty table gives no
    rows. Equal texts have one answer. hashes: also h1 and h2, which tell the text of a row.
    """
    docs = docs.select("doc_id", "text")
    n_docs = docs.count()
    sig = written(signatures(docs, n_docs, shingle, spread))
    shingled = sig.where("bands is not null and doc_id is not null")
    reps = shingled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by(F.length("codes"), "doc_id").alias("width"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))
    posted = reps.select("node", "width", F.posexplode("bands").alias("band", "key"))
    heads = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.min("band").alias("band")).where("n > 1")
    # buckets of the same texts: the one of the first band stands for all
    heads = heads.groupBy("n", "lead", "all").agg(F.min_by("key", F.struct("band", "key")).alias("key"))
    members = written(posted.join(heads.select("key", "lead"), "key").where("node <> lead").select("key", "lead", "node", "width"))
    nodes = members.select("node").unionByName(members.select(F.col("lead").alias("node"))).distinct()
    full = written(candidates(docs, sig, reps, nodes))
    found = written(compared_to_leaders(members, full, n_docs, shingle, spread))
    first = found.where(F.col("s") >= threshold - 1e-9).select("a", "b")
    left = unresolved(members, found, components(first), threshold).join(full, "node")
    more = written(left.groupBy("key", "lo", "hi").applyInArrow(_block_kernel(n_docs, shingle, spread, threshold), "a long, b long"))
    linked = components(first.unionByName(more))
    classes = reps.select("node", "rep", "h1", "h2").join(linked, "node", "left")
    least = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    classes = classes.join(least, "component", "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep", F.coalesce("least", "rep").alias("least"))
    named = sig.select("doc_id", "h1", "h2", (F.col("bands").isNotNull() & F.col("doc_id").isNotNull()).alias("known"))
    out = named.join(classes, F.col("known") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", *(["h1", "h2"] if hashes else []), F.coalesce("rep", "doc_id").alias("rep_id"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
