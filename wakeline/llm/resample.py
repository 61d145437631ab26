"""Target-distribution importance resampling.

Identical texts are collapsed first, by grouping the full text; features are hashed, counted and weighted once for each distinct
text, with counts multiplied by its number of copies. Weights then go back to the documents over a digest of the text, and each
document gets its own noise (Gumbel, from a hash of its id), so that the highest scores are a draw without replacement.

DataFrame functions throughout. What is held whole is bounded by parameters: one gain for each of `buckets` buckets, and the
weights of texts that make up a thousandth of the documents each or more, of which there are a thousand at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import checkpointed, written
from .mixing import let

#: Fixed values of the contract: letters that are lowered, words, and the seed in the hash.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED = 2024
#: Texts of this share of the documents and more are joined by broadcast: 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001
#: Width of the histogram of scores that tells which rows can be drawn.
STEP = 100


def features(text: Column, longest: int = 1) -> Column:
    """All runs of 1 to `longest` consecutive words of a text, joined by a space, repeats included; null: none."""
    words = F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    if longest == 1:
        return words

    def runs(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda k: F.array_join(F.slice(w, k, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.concat(w, *(runs(w, n) for n in range(2, longest + 1))))


def buckets_of(text: Column, buckets: int, longest: int = 1) -> Column:
    return F.transform(features(text, longest), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def collapsed(docs: DataFrame, buckets: int, longest: int = 1) -> DataFrame:
    """One row per distinct text: copies, digest, number of words, and the bucket of each feature. Copies are counted before
    the shuffle, so a text is sent once by each task that has it."""
    texts = docs.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select("copies", digest("text").alias("digest"), F.size(features(F.col("text"))).cast("long").alias("n_words"), buckets_of(F.col("text"), buckets, longest).alias("found"))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """Features in each bucket, over all copies: bucket, n."""
    return texts.select("copies", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain = floor(1000 * ln of the ratio of smoothed shares), for every bucket."""
    raw, target = raw.select(F.col("bucket").alias("b1"), F.col("n").alias("s")), target.select(F.col("bucket").alias("b2"), F.col("n").alias("t"))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw, F.col("bucket") == F.col("b1"), "left").join(target, F.col("bucket") == F.col("b2"), "left")
    both = checkpointed(both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st")))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * (all_s + buckets)) / ((F.col("s") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(texts: DataFrame, gain: DataFrame) -> DataFrame:
    """copies, digest, n_words, n_features, weight: the floored mean of the gains of a text's features (none: 0)."""
    in_order = F.array_sort(F.collect_list(F.struct("bucket", "gain")))
    held = gain.agg(F.transform(in_order, lambda x: x["gain"]).alias("gains")).scalar()  # one long for each bucket
    total = F.aggregate("found", F.lit(0).cast("long"), lambda acc, b: acc + F.get("gains", b))
    out = texts.withColumn("gains", held).select("copies", "digest", "n_words", F.size("found").cast("long").alias("n_features"), total.alias("total"))
    return out.select("copies", "digest", "n_words", "n_features", F.expr("case when n_features > 0 then (total - pmod(total, n_features)) div n_features else 0 end").alias("weight"))


def noise(doc_id: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id (a null id counts as the text `null`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def joined_back(docs: DataFrame, weights: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document, by its text's digest; no text is sent.

    A text with so many copies that only 1 / hot_share texts can have them is answered by broadcast; of the others no key
    has more copies than that. Rows that have nothing left to look for get a key of their own.
    """
    names = ["n_words", "n_features", "weight"]
    rows = weights.agg(F.sum("copies")).first()[0] or 0
    least = max(2, hot_share * rows)
    hot = weights.where(F.col("copies") >= least).select("digest", F.struct(*names).alias("hot"))
    cold = weights.where(F.col("copies") < least).select(F.col("digest").alias("found_digest"), F.struct(*names).alias("cold"))
    near = docs.select("doc_id", digest("text").alias("mine")).join(F.broadcast(hot), F.col("mine") == F.col("digest"), "left")
    own = F.unhex(F.hex(F.monotonically_increasing_id()))  # 8 bytes at most, so no text's digest
    near = near.select("doc_id", "hot", F.when(F.col("hot").isNull() & F.col("mine").isNotNull(), F.col("mine")).otherwise(own).alias("look_for"))
    both = near.join(cold, F.col("look_for") == F.col("found_digest"), "left").withColumn("w", F.coalesce("hot", "cold"))
    return both.select("doc_id", *(F.coalesce(F.col("w")[n], F.lit(0).cast("long")).alias(n) for n in names))


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds rank to the rows of the draw. A histogram of the scores (whole numbers of a few tens of thousands, so a few hundred
    steps) tells which rows can be drawn: only these are sorted, over range partitions."""
    columns = ["doc_id", "n_features", "weight", "score"]
    scored = checkpointed(scored)
    step = F.floor(F.col("score") / STEP)
    steps = sorted(((r["step"], r["n"]) for r in scored.where(F.col("n_words") >= least_words).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    k, above, cut = percent * sum(n for _, n in steps) // 100, 0, None
    for at, n in steps:
        if above >= k:
            break
        above, cut = above + n, at * STEP
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    may = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    top = ranked(scored.where(may).select(*columns), [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features")])
    return top.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")).unionByName(scored.where(~may).select(*columns, none))


def resampled(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = SEED, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1 for the highest score drawn; null: not drawn).

    Of the N documents with at least least_words words, floor(percent * N / 100) are drawn, ties to the smaller doc_id (null
    first). Null and empty texts, and texts without words, have no features and weight 0. Rows of one id share their noise;
    rows alike in id and text may swap ranks. Without target texts all target counts are 0; an empty table gives no rows.
    Other columns are ignored. Reruns agree.
    """
    if not 0 <= percent <= 100 or longest < 1:
        raise ValueError("percent must be within 0 and 100, and longest at least 1")
    texts = written(collapsed(docs, buckets, longest))
    one = F.lit(1).cast("long").alias("copies")
    others = target.where("text is not null").select(one, buckets_of(F.col("text"), buckets, longest).alias("found"))
    weights = checkpointed(weighted(texts, gains(bucket_counts(texts), bucket_counts(others), buckets)))
    scored = joined_back(docs, weights, hot_share).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return drawn(scored, least_words, percent)
