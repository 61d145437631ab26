"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, pieces, segment_hash, text_buffer, windows, written

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bits of the map of trusted ids (4 MB) that keeps most other texts out of the join with them.
ID_BITS = 1 << 25


def _grams(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of every word and every pair of words in a row (ASCII letters lowered)."""
    w = Words(LOWER[data], at)
    i, two = windows(w, 2)
    return np.concatenate([w.text, w.text[i]]), (np.concatenate([w.hash, two]) % np.uint64(buckets)).astype(np.int64)


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(at) - 1
    w = Words(data, at)

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[at[1:]] - c[at[:-1]]

    out = {"n_words": w.count, "word_chars": per_text(w.inside & ((data & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOL[data])}
    if len(data):
        newline = data == 10
        begin = np.zeros(len(data) + 1, bool)
        begin[at[:-1]] = True
        begin[1:] |= newline
        starts = np.flatnonzero(begin[:-1] & ~newline)  # an empty line has no word
        text = np.searchsorted(at, starts, side="right") - 1
        h = segment_hash(data, starts, ~newline)
        worded = np.add.reduceat(w.inside.astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
        text, h = text[worded], h[worded]
        order = np.lexsort((h, text))
        again = (text[order][1:] == text[order][:-1]) & (h[order][1:] == h[order][:-1])
        out["n_dup_lines"] = np.bincount(text[order][1:][again], minlength=n).astype(np.int64)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    i, h = windows(w, 3)
    covered = np.zeros(len(w.start) + 1, bool)
    if len(i):
        order = np.lexsort((h, w.text[i]))
        t, s = w.text[i][order], h[order]
        same = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
        twice = np.zeros(len(i), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = i[order][twice]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(w.text[covered[:-1]], minlength=n).astype(np.int64)
    return out


def _count_kernel(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, at = text_buffer(batch.column(0))
                n += np.bincount(_grams(data, at, buckets)[1], minlength=buckets)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["bucket", "n"])

    return run


def _bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many words and word pairs of a column of texts fall into each bucket."""
    rows = texts.mapInArrow(_count_kernel(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    n = np.zeros(buckets)
    n[rows["bucket"]] = rows["n"]
    return n


def _score(data, at, ratio: np.ndarray) -> np.ndarray:
    text, bucket = _grams(data, at, len(ratio))
    n = len(at) - 1
    total, count = np.bincount(text, ratio[bucket], n), np.bincount(text, minlength=n)
    return np.divide(total, count, out=np.zeros(n), where=count > 0)


def _score_kernel(ratio_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratio_of.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, at = text_buffer(batch.column(1))
                base = base_counts(data, at)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                columns = [batch.column(0), *(pa.array(base[k]) for k in BASE_COUNTS), pa.array(failed), pa.array(_score(data, at, ratio))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE_COUNTS, "base_failed", "score"])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled good and not toxic (in every row that has the id)."""
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return ids.where("q = 1 and t = 0").select("trusted_id")


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The text of every row of docs whose id is trusted. A broadcast bitmap of hashed ids, whose size is fixed, first drops
    most of the others, so that their texts are not shuffled; the join with the ids themselves decides."""
    place = lambda c: (F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(ID_BITS)) + 1).alias("place")
    bits = ids.select(place("trusted_id")).select(F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("bit"))
    bits = bits.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = "cast(bitmap_bit_position(place) as int)"
    known = f"bitmap_bucket_number(place) = part and getbit(cast(conv(hex(substring(bits, {at} div 8 + 1, 1)), 16, 10) as int), {at} % 8) = 1"
    likely = docs.select("doc_id", "text", place("doc_id")).join(F.broadcast(bits), F.expr(known), "left_semi")
    return likely.join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi").select("text")


def quality_rules(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, spread: float = 4.0, smoothing: float = 1.0) -> DataFrame:
    """One row per document: base counts, base_failed, kept, score.

    score is the mean over a text's words and word pairs of log(p_target / p_raw), p being smoothed shares of
    `buckets` hash buckets; p_raw covers every document, p_target all the trusted ones. A text is kept when its base rules hold and its score is no less than the trusted texts' mean
    less `spread` standard deviations: a fixed cut for the whole table, equal texts get equal verdicts. With no trusted
    text all ratios are 0 and the base rules decide. Null and empty texts have no word, score 0, and fail the base
    rules. Repeated rows each get a row; columns other than doc_id and text are ignored. Counts and scores are written once,
    so that the cut comes from the written scores and no text is shuffled for it.
    """
    spark = docs.sparkSession
    ids = trusted_ids(labels)  # broadcast by Spark where they are few
    raw, target = _bucket_counts(docs.select("text"), buckets), _bucket_counts(trusted_texts(docs, ids), buckets)
    ratio = np.zeros(buckets)
    if target.sum():
        ratio = np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))
    ratio_of = spark.sparkContext.broadcast(ratio)
    names = ", ".join(f"{k} long" for k in BASE_COUNTS)
    scored = written(docs.select("doc_id", "text").mapInArrow(_score_kernel(ratio_of), f"doc_id long, {names}, base_failed boolean, score double"))
    fit = scored.join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi").agg(F.avg("score"), F.stddev_pop("score")).first()
    threshold = float("-inf") if fit[0] is None else fit[0] - spread * fit[1]
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    return scored.select("doc_id", *BASE_COUNTS, "base_failed", kept.alias("kept"), "score")
