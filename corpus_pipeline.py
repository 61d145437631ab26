"""Documents to training pieces: language ID, near-dedup, PII, mixing, SentencePiece encoding.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents (and any extra ones docs has). run() writes what each stage returns into the shared folder and reads it for
the next one.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import crc_rest, forget, fresh, written
from wakeline.llm.langid import fit, identified, training_rows
from wakeline.llm.minhash import near_duplicates, text_hashes
from wakeline.llm.mixing import mix
from wakeline.llm.pieces import sampled
from wakeline.llm.pii import pseudonymised, session_key
from wakeline.shipping import ship

#: A text goes when it has no letter, or when its best language is no more likely than this.
LEAST_SCORE = 0.5
#: A text of so many characters goes when its language knows a smaller share of its words (junk, or a language never learned).
SHORT, LEAST_KNOWN = 40, 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts whose language is told; a missing lang is filled with it.

    Null texts, and texts without a letter, go; ties go to the first language by name; repeated rows are judged alike; an
    empty table stays empty. Extra columns stay, whatever their names.
    """
    ship(spark)
    model = fit(training_rows(docs, crc_rest("doc_id", 3) == 1))
    lang, score, known = (fresh(docs, n) for n in ("lang_pred", "score", "known_share"))
    told = identified(docs, model, added=(lang, score, known)).where((F.col(lang) != "und") & (F.col(score) > LEAST_SCORE))
    return told.where((F.length("text") < SHORT) | (F.col(known) >= LEAST_KNOWN)).withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least id, of each group of copies and near copies.

    Null texts and texts without words are alone and stay; so do rows without an id. Of rows that share id and text one
    stays, the least by its other columns; rows that share the id only are judged each by its text. Extra columns stay,
    whatever their names; an empty table stays empty.
    """
    ship(spark)
    judged = written(near_duplicates(docs, hashes=True)).where("doc_id is not null")
    doc, h1, h2 = (fresh(docs, n) for n in ("dropped_id", "h1", "h2"))
    gone = judged.where("not kept").select(F.col("doc_id").alias(doc), F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    of = text_hashes()
    kept = docs.join(gone, (F.col("doc_id") == F.col(doc)) & (of["h1"] == F.col(h1)) & (of["h2"] == F.col(h2)), "left_anti")
    rows, ids = judged.where("kept").agg(F.count("*"), F.count_distinct("doc_id", "h1", "h2")).first()
    if rows == ids:
        return kept
    other = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    named = kept.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.struct(*other).alias("order"))
    one = named.groupBy("row.doc_id", F.xxhash64("row.text").alias("h1"), F.xxhash64(F.lit(2), "row.text").alias("h2")).agg(F.min_by("row", "order").alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data in the texts, under the key of the setting spark.wakeline.pii.key (unset: the session's own).

    Null and empty texts stay as they are; repeated rows are rewritten alike; n_chars follows the text; extra columns
    stay, whatever their names; an empty table stays empty.
    """
    ship(spark)
    done = pseudonymised(docs, key=session_key(spark), counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words come to their targets.

    Null texts and texts without words count no words; a null source is a source. Rows alike in id, source and text share
    their copies evenly. Extra columns stay, whatever their names; an empty table stays empty.
    """
    key, copies, rows, nth = (fresh(docs, n) for n in ("row_key", "copies", "rows", "nth"))
    # written first, so that the plan of the join is a small one
    taken = written(mix(docs).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "source", "text")).join(taken.where(F.col(copies) > 0), key)
    own = F.col(copies)
    if (taken.agg(F.max(rows)).first()[0] or 0) > 1:
        joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
        own = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("long")
    return joined.withColumn(nth, F.explode(F.when(own > 0, F.sequence(F.lit(1).cast("long"), own)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws a segmentation into pieces for each text: doc_id, lang, source, text, piece_ids, n_pieces, lossless.

    A null text has null ids, an empty one none; rows of one id and text are segmented alike; extra columns go; an empty
    table stays empty.
    """
    ship(spark)
    return sampled(docs.select("doc_id", "lang", "source", "text"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mix_sources", mix_sources), ("encode", encode)]
#: Hashing, sampling and model fitting have no SQL equivalent; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            forget(before)  # the stage after it is written, so nothing reads it again
        gc.collect()  # models and broadcasts of the stage
    return STAGES[-1][1](spark, docs, sf_dir)
