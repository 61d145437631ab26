"""Mixing sources to target weights: capped targets, then pivotal dependent rounding over a reduction tree.

DataFrame functions only. Every document of a source should be copied target / source_size times; the whole part is
certain and the fractional part is settled by duels: two units of similar size meet, words move from one to the other
until one of them is integral, the other goes on to the next. A fold settles each group of about `fan_in` units, from the
largest down, and leaves one fractional unit at most, which goes up to the next level of the tree; the last level is the
source as a whole.

The unit left over carries a source's error, so it must be small: the tree first settles the documents above the
upper quartile of the source's sizes; the one left of them meets the smaller ones, which all have one probability still,
as one unit, and is settled by a small change of that probability; then the tree settles the smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, checkpointed

#: A probability within this of 0 or 1 counts as integral (rounding noise of the duels).
EPS = 1e-9
WEIGHTS = (1.0, 2.0, 3.0)


def uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / float(1 << 53)


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source with its size, weight by rank in code point order (null last), rank, and quartile: a size that a
    quarter of its rows at most exceed.

    The quartile is one of the steps of a histogram (eight to an octave), so it depends on the rows alone, not on how they
    are dealt. Ranks come from range partitions and their counts, so no task has all the sources.
    """
    spare = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))  # bits beyond the first four
    counts = sizes.withColumn("spare", spare).groupBy("source", F.expr("shiftleft(shiftright(size, spare), spare)").alias("step")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("step"))  # a few hundred steps at most
    counts = counts.withColumn("above", F.sum("n").over(down)).withColumn("rows", F.sum("n").over(Window.partitionBy("source")))
    few = F.min(F.when(4 * F.col("above") <= F.col("rows"), F.col("step"))) - 1
    per = counts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"), F.coalesce(few, F.max("step") * 2).alias("quartile"))
    per = checkpointed(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = per.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    rank = per.withColumn("within", within).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("within") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    return rank.select("source", "source_size", "rows", "quartile", weight.alias("weight"))


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, rows, quartile (about the upper quartile of its sizes), target: shares by weight of all sizes, none above cap times its source's size.

    The level (words per unit of weight) rises until the capped sources no longer change: each round is one small
    aggregate, and the driver sees two numbers.
    """
    sources = checkpointed(ranked_sources(sizes))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, over = 0.0, None
    while True:
        capped = F.col("source_size") * cap <= F.col("weight") * level
        n, held, free = sources.agg(F.sum(capped.cast("long")), F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == over or not free:
            break
        over, level = n, (total - cap * (held or 0)) / free
    target = F.least(F.col("source_size") * cap, F.col("weight") * level)
    return sources.select("source", "source_size", "rows", "quartile", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


UNIT = "struct<less:long, key:long, doc_id:bigint, size:long, rows:long, whole:long, p:double>"
FIELDS = ["less", "key", "doc_id", "size", "rows", "whole", "p"]


def let(value: Column, body) -> Column:
    """body(value), with the value computed (and written into the plan) once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def integral(p: Column) -> Column:
    return (p <= EPS) | (p >= 1 - EPS)


def transfer(draw: Column, size_a: Column, p_a: Column, size_b: Column, p_b: Column) -> Column:
    """Words that a gains from b (less than 0: b from a), as many as make one of them integral: up or down by chances that
    leave each one's expectation, and the words of both together, as they are."""
    up, down = F.least((1 - p_a) * size_a, p_b * size_b), F.least(p_a * size_a, (1 - p_b) * size_b)
    return let(F.struct(up.alias("up"), down.alias("down")), lambda v: F.when(draw * (v["up"] + v["down"]) < v["down"], v["up"]).otherwise(-v["down"]))


def _duel(seed: int) -> Column:
    """Folds the units of a group from the largest down: out has the settled ones, last the one still fractional."""
    unit = T._parse_datatype_string(UNIT)
    nothing = F.lit(None).cast(unit)
    start = F.struct(F.array().cast(T.ArrayType(unit)).alias("out"), nothing.alias("last"))

    def state(out: Column, last: Column) -> Column:
        return F.struct(out.alias("out"), last.alias("last"))

    def settle(acc: Column, b: Column) -> Column:
        a = acc["last"]
        moved = transfer(uniform(seed, a["key"], b["key"]), a["size"], a["p"], b["size"], b["p"])
        met = let(moved, lambda m: F.struct(a.withField("p", a["p"] + m / a["size"]).alias("a"), b.withField("p", b["p"] - m / b["size"]).alias("b")))

        def after(v: Column) -> Column:
            x, y = v["a"], v["b"]
            both = state(F.concat(acc["out"], F.array(x, y)), nothing)
            return F.when(~integral(y["p"]), state(F.concat(acc["out"], F.array(x)), y)).when(integral(x["p"]), both).otherwise(state(F.concat(acc["out"], F.array(y)), x))

        return F.when(a.isNull(), state(acc["out"], b)).otherwise(let(met, after))

    return F.aggregate(F.array_sort("units"), start, settle)


def tree(left: DataFrame, most: int, seed: int, fan_in: int) -> tuple[list[DataFrame], DataFrame]:
    """Settled units of each level, and what is left of each source: one unit at most."""
    settled, group, level = [], fan_in, 0
    while True:
        # groups of about fan_in units, by a salt; a source of fewer rows is one group
        salt = F.pmod(F.xxhash64(F.lit(seed + 17 + level), "key"), F.ceil(F.col("rows") / group))
        folded = left.withColumn("salt", salt).groupBy("source", "salt").agg(F.collect_list(F.struct(*FIELDS)).alias("units"))
        folded = checkpointed(folded.select("source", _duel(seed + level).alias("d")))
        settled.append(folded.select("source", F.explode("d.out").alias("u")).select("source", "u.*"))
        left = folded.where("d.last is not null").select("source", "d.last.*")
        if group >= most:
            return settled, left
        group, level = group * fan_in, level + 1


def pivotal_copies(units: DataFrame, most: int, *, seed: int = 1, fan_in: int = 256) -> DataFrame:
    """units: source, quartile and FIELDS, open ones of a source with one p; most: the rows of the largest source. Adds
    copies = whole + 0 or 1.

    A unit's chance of the extra copy is p; a source's words differ from their expectation by one unit at most, one of the
    smaller three quarters where these can settle the one left of the larger ones.
    """
    open_, large = (F.col("p") > EPS) & (F.col("p") < 1 - EPS) & (F.col("size") > 0), F.col("size") > F.col("quartile")
    parts = [units.where(~open_).select("source", *FIELDS)]
    settled, last = tree(units.where(open_ & large).select("source", *FIELDS), most, seed, fan_in)
    parts += settled
    small = units.where(open_ & ~large).select("source", *FIELDS)
    pool = small.groupBy(F.col("source").alias("source_")).agg(F.sum("size").alias("pool"), F.first("p").alias("common"))
    met = last.join(pool, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    moved = F.when(F.col("pool").isNull(), 0.0).otherwise(transfer(uniform(seed + 98, "key"), F.col("size"), F.col("p"), F.col("pool"), F.col("common")))
    met = checkpointed(met.withColumn("moved", moved).withColumn("p", F.col("p") + F.col("moved") / F.col("size")).withColumn("common", F.col("common") - F.col("moved") / F.col("pool")))
    common = met.where("common is not null").select(F.col("source").alias("source_"), "common")  # a row per source at most
    moved_on = small.join(common, F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("p", F.coalesce("common", "p")).select("source", *FIELDS)
    settled, rest = tree(moved_on, most, seed + 50, fan_in)
    parts += settled
    # what is left of a source: its own draw
    for left in (met.select("source", *FIELDS), rest):
        parts.append(left.withColumn("p", (uniform(seed + 99, "key") < F.col("p")).cast("double")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x.select(out.columns))
    return out.select("source", "doc_id", "size", "key", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, *, cap: float = 3.0, seed: int = 1, fan_in: int = 256, row_key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    size is the number of words (null text: 0). Sources by code point, null last, weigh 1, 2, 3 in turn. Null doc_ids and
    repeated rows are units of their own (rows alike in id, source and text may swap places). Texts without words
    take nothing; an empty table gives no rows. Extra columns are ignored. Reruns agree: draws are hashes of the row.
    """
    key = F.xxhash64("doc_id", "source", "text") if row_key is None else row_key
    sizes = checkpointed(docs.select("doc_id", "source", words_in("text").alias("size"), key.alias("key")))
    targets = checkpointed(source_targets(sizes.select("source", "size"), cap))
    # the table of sources is joined as it comes: small ones are broadcast by Spark under its own size check
    renamed = targets.withColumnRenamed("source", "source_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)
    joined = sizes.join(renamed, F.col("source").eqNullSafe(F.col("source_"))).withColumn("rate", rate)
    units = joined.select("source", "quartile", (-F.col("size")).alias("less"), "key", "doc_id", "size", "rows", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"))
    copies = pivotal_copies(units, targets.agg(F.max("rows")).first()[0] or 0, seed=seed, fan_in=fan_in)
    out = copies.join(renamed, F.col("source").eqNullSafe(F.col("source_")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "key")
