"""Language ID by word-first backoff: known words by per-language log frequency, else ever shorter character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Runs of letters, and of number signs that are no digits (a half, a Roman eight).
RUN = re.compile(r"[^\W\d_]+")
#: Words, and numbers, that a worker's cache holds at most; words of a text that are looked up at once.
CACHE, CACHE_NUMBERS, PART = 100_000, 1 << 22, 4096
SEED = 42  # fixed value: the seed of Spark's xxhash64
WORD = "w"


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text, lowered."""
    runs = RUN.findall(text.lower())
    if text.isascii():
        return runs
    return [part for run in runs for part in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Model:
    """Log frequencies of words, and of n-grams of every length, by the hash of their level and text (sorted). A word takes the
    row of the longest level that knows it: its own, or the mean over its known n-grams of that length."""

    def __init__(self, langs: list[str], longest: int, keys: np.ndarray, logs: np.ndarray, seen: np.ndarray):
        self.langs, self.longest, self.keys, self.logs, self.seen = langs, longest, keys, logs, seen

    def find(self, texts: list[str]) -> np.ndarray:
        """The places of level-marked texts, -1 for those not known."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1)
        h = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=SEED) for t in texts], np.uint64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """For each word: log frequencies in each language, then 1 for each language that has the word."""
        n = len(self.langs)
        out = np.zeros((len(words), 2 * n))
        i = self.find([WORD + w for w in words])
        hit = i >= 0
        out[hit, :n], out[hit, n:] = self.logs[i[hit]], self.seen[i[hit]]
        left = np.flatnonzero(~hit)
        for size in range(self.longest, 0, -1):
            owner, grams = [], []
            for k in left.tolist():
                padded = f" {words[k]} "
                cut = [f"{size}{padded[j : j + size]}" for j in range(len(padded) - size + 1)]
                grams += cut
                owner += [k] * len(cut)
            i, owner = self.find(grams), np.array(owner, np.int64)
            known = i >= 0
            i, owner = i[known], owner[known]
            many = np.bincount(owner, minlength=len(words))
            for x in range(n):
                out[:, x] += np.bincount(owner, self.logs[i, x], len(words)) / np.maximum(many, 1)
            left = left[many[left] == 0]
            if not len(left):
                break
        return out

    def scorer(self):
        """A function of a text: language, score and share of known words. Rows of words met before are kept (a bounded
        cache)."""
        n = len(self.langs)
        table = np.zeros((min(CACHE, CACHE_NUMBERS // (2 * n)) if n else 0, 2 * n))
        known: dict[str, int] = {}

        def score(text: str | None) -> tuple[str, float, float]:
            words = letter_runs(text) if text and n else ()
            if not words:
                return "und", 0.0, 0.0
            total = np.zeros(2 * n)
            for i in range(0, len(words), PART):  # a part at a time, so that the cache may be emptied between
                own = words[i : i + PART]
                new = [w for w in dict.fromkeys(own) if w not in known]
                if len(known) + len(new) > len(table):
                    known.clear()
                    new = list(dict.fromkeys(own))
                if new:
                    table[len(known) : len(known) + len(new)] = self.rows(new)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                total += table[[known[w] for w in own]].sum(0)
            best = int(np.argmax(total[:n]))  # ties: the first language by name
            return self.langs[best], float(1 / np.exp(np.clip(total[:n] - total[best], -700, 0)).sum()), float(total[n + best] / len(words))

        return score


def fit(labelled: DataFrame, *, per_lang: int = 2_000, longest: int = 5, smoothing: float = 0.5) -> Model:
    """labelled: doc_id, text, lang. Learns from at most about per_lang texts of each language, chosen by hash of the id (the
    bound of the sample, and so of the model): all their words, and all n-grams of up to `longest` characters."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("texts"))
    langs = [r["lang"] for r in sizes.orderBy("lang").collect()]  # one row per language
    if not langs:
        return Model([], longest, np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), bool))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id"), 11).cast("double") / float(1 << 53)
    # a row per language, as many as the driver has just seen; the texts are not dealt by language
    sample = labelled.join(F.broadcast(sizes), "lang").where(draw < per_lang / F.col("texts")).select("lang", "text")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))

    def grams(size: int) -> Column:
        at = F.sequence(F.lit(1), F.length(padded) - size + 1)
        return F.when(F.length(padded) >= size, F.transform(at, lambda k: F.concat(F.lit(str(size)), F.substr(padded, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))

    each = words.select("lang", "n", F.explode(F.concat(F.array(F.concat(F.lit(WORD), "word")), *map(grams, range(1, longest + 1)))).alias("key"))
    counts = each.groupBy("key").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{k}") for k, x in enumerate(langs)))
    found = counts.select(F.xxhash64("key").alias("h"), F.ascii("key").alias("level"), *(f"c{k}" for k in range(len(langs)))).toArrow()  # bounded by the sample
    keys = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    level = found["level"].to_numpy()[order]
    count = np.stack([found[f"c{k}"].to_numpy()[order] for k in range(len(langs))], axis=1).astype(np.float32)
    logs = np.empty_like(count)
    for x in np.unique(level):
        own = level == x
        logs[own] = np.log((count[own] + smoothing) / (count[own].sum(0, dtype=float) + smoothing * (own.sum() + 1)))
    return Model(langs, longest, keys[order], logs, count > 0)


def _kernel(model_of, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model_of.value.scorer()
        for batch in batches:
            done = [score(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            columns = [*batch.columns, pa.array([x[0] for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return run


def identified(df: DataFrame, model: Model, *, added: tuple[str, str, str] = ("lang_pred", "score", "known_share")) -> DataFrame:
    """df with three columns added (own columns of those names are replaced): the language, its posterior (0 to 1), and the
    share of the text's words that the language's sample has.

    A null text, or one without a letter, is `und` with 0 and 0; so is every text when nothing was learned. Whole texts
    count; ties go to the first language by name; repeated rows are scored alike; an empty table gives no rows.
    """
    df = df.drop(*added)
    model_of = df.sparkSession.sparkContext.broadcast(model)  # bounded by fit's sample
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{added[0]}` string, `{added[1]}` double, `{added[2]}` double"])
    return df.mapInArrow(_kernel(model_of, [*df.columns, *added]), schema)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """The rows to learn from: not held out (null: not), with a language. Null texts are left out by fit."""
    return docs.where(~F.coalesce(held_out, F.lit(False)) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
