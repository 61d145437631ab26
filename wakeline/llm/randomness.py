r"""Secret scans: known forms, and a battery of randomness tests over what they leave.

DataFrame functions only. Candidates are whole runs of 16 and more of `[A-Za-z0-9+/_-]` (with `=` padding) outside the known
forms' spans. The smallest alphabet that holds a run is taken as its encoding: hex, base32, base36, base62 or base64. Under the
hypothesis that each character is drawn uniformly from it, with moments exact for the run's length:

- uniformity: chi-squared over the alphabet's symbols, and over its classes (lower, upper, digit, mark), which has power where
  the run is shorter than the alphabet;
- runs: the number of changes of class from one character to the next;
- serial correlation of neighbouring values (their places in the alphabet).

A run that deviates in any of them by more than REJECT, or in all together (sum of squares) by more than TOTAL, is structured:
together the bounds reject about one random string in a hundred. The others are held against ordinary strings, whose class changes from one character to the next with a probability of ORDINARY at
most: the chance of as many changes as seen is bounded by exp(-(n-1) KL) (Chernoff), which the length enters exactly. These
chances are put through Benjamini-Hochberg at level FDR within each encoding and half octave of length, over all documents, so
that many short runs, which have no power, neither pass nor decide about the long ones. Structured runs count with chance 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .mixing import let

#: Fixed values of the contract: kinds in order, their patterns, the group that must have so many characters.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}"}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: pattern, alphabet of the run once it is brought to one form, and the classes' sizes (lower, upper, digit, mark).
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6], (6, 0, 10, 0)), "base32": ("^[A-Z2-7]+$", UPPER + DIGITS[2:8], (0, 26, 6, 0)), "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, (26, 0, 10, 0)),
    "base62": ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, (26, 26, 10, 0)), "base64": ("", UPPER + LOWER + DIGITS + "-_", (26, 26, 10, 2)),
}
REJECT, TOTAL, ORDINARY, FDR = 3.7, 18.5, 0.1, 0.01
#: Chances are kept in tenths of a power of ten, rounded up; beyond the last step they count as that.
STEPS_OF_TEN, LAST_STEP = 10, 400
#: Array elements that are summed up in one go; characters of a run that are taken apart at once.
CHUNK, PART = 256, 1024


def running(x: Column) -> Column:
    """Running sums of an array of longs; in chunks, so that the work is about linear in its length."""
    zero = F.lit(0).cast("long")

    def sums(v: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(v, start, lambda acc, y: F.struct((acc["sum"] + y).alias("sum"), F.array_append(acc["out"], acc["sum"] + y).alias("out")))["out"]

    def put_together(chunks: Column) -> Column:
        before = sums(F.concat(F.array(zero), F.transform(chunks, lambda c: F.element_at(c, -1))))
        added = lambda b: F.transform(F.arrays_zip(chunks.alias("chunk"), b.alias("before")), lambda p: F.transform(p["chunk"], lambda y: y + p["before"]))
        return F.flatten(let(F.slice(before, 1, F.size(chunks)), added))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: sums(F.slice(x, k * CHUNK + 1, CHUNK)))
    return F.when(F.size(x) == 0, F.array().cast("array<long>")).otherwise(let(parts, put_together))


def split_at(df: DataFrame, text: str, pattern: str, *, least: tuple[int, int] = (0, 0), name: str) -> DataFrame:
    """Adds `name`: (start, end, hit, ok) of the leftmost non-overlapping matches, in code points; and `name`_gaps: what is
    between them. Positions come from the lengths of the gaps and matches."""
    group, length = least
    has = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    extract = lambda g: F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).otherwise(none)
    df = df.withColumn("__hit", extract(0)).withColumn(f"{name}_gaps", F.when(has, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("__own", extract(group) if group else F.col("__hit"))
    steps = F.zip_with(F.slice(f"{name}_gaps", 1, F.size("__hit")), "__hit", lambda g, h: F.array(F.length(g).cast("long"), F.length(h).cast("long")))
    found = F.struct(F.col("__hit").alias("hit"), F.col("__own").alias("own"), running(F.flatten(steps)).alias("at"))

    def placed(v: Column) -> Column:  # of one value, worked out once, as lambdas work out what they hold for each element
        one = lambda h, k: F.struct(F.get(v["at"], 2 * k).alias("start"), F.get(v["at"], 2 * k + 1).alias("end"), h.alias("hit"), (F.length(F.get(v["own"], k)) >= length).alias("ok"))
        return F.transform(v["hit"], one)

    return df.withColumn(name, let(found, placed)).drop("__hit", "__own")


def blanked(name: str, text: str) -> Column:
    """The text with the good matches of `name` overwritten by as many spaces."""
    filled = F.transform(name, lambda m: F.when(m["ok"], F.repeat(F.lit(" "), F.length(m["hit"]))).otherwise(m["hit"]))
    ends = F.concat(filled, F.array(F.lit("")))
    return F.when(F.size(name) == 0, F.col(text)).otherwise(F.array_join(F.zip_with(f"{name}_gaps", ends, lambda g, h: F.concat(g, h)), ""))


def by_encoding(value: Callable[[str], object], encoding: Column) -> Column:
    """The value that belongs to the encoding."""
    out = None
    for e in ENCODINGS:
        v = value(e)
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(encoding == e, v) if out is None else out.when(encoding == e, v)
    return out


def encoding_of(run: Column) -> Column:
    out = None
    for e, (pattern, _, _) in ENCODINGS.items():
        if pattern:
            out = F.when(run.rlike(pattern), e) if out is None else out.when(run.rlike(pattern), e)
    return out.otherwise("base64")


def class_moments(sizes: tuple[int, ...]) -> tuple[float, float]:
    """Sums of squares and of cubes of the classes' shares."""
    k = sum(sizes)
    return sum((c / k) ** 2 for c in sizes), sum((c / k) ** 3 for c in sizes)


def battery(run: Column) -> Column:
    """encoding, n, and the deviates of a run of characters: symbols, classes, runs, serial; and changes, its changes of class."""
    bare = F.regexp_replace(run, "=+$", "")
    named = F.struct(bare.alias("run"), encoding_of(bare).alias("e"))

    def formed(v: Column) -> Column:
        run, e = v["run"], v["e"]
        u = F.when(e.isin("hex", "base36"), F.lower(run)).when(e == "base64", F.translate(run, "+/", "-_")).otherwise(run)
        return F.struct(u.alias("u"), e.alias("e"), F.length(run).cast("double").alias("n"), by_encoding(lambda x: float(len(ENCODINGS[x][1])), e).alias("k"), by_encoding(lambda x: ENCODINGS[x][1], e).alias("alphabet"))

    def tested(v: Column) -> Column:
        u, e, n, k = v["u"], v["e"], v["n"], v["k"]
        count = lambda symbol: n - F.length(F.replace(u, symbol, F.lit("")))
        squares = F.aggregate(F.split(v["alphabet"], ""), F.lit(0.0), lambda acc, s: acc + F.when(s == "", 0.0).otherwise(F.pow(count(s), F.lit(2))))
        symbols = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

        def classes_of(x: str) -> Column:
            size, total, df = ENCODINGS[x][2], sum(ENCODINGS[x][2]), sum(c > 0 for c in ENCODINGS[x][2]) - 1
            off = sum((F.pow(n - F.length(F.translate(u, letters, "")) - n * (c / total), F.lit(2)) / (n * (c / total)) for letters, c in zip((LOWER, UPPER, DIGITS, "-_"), size, strict=True) if c), F.lit(0.0))
            return (F.cbrt(off / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5  # Wilson and Hilferty's normal deviate

        changes = (F.regexp_count(u, F.lit("[a-z]+|[A-Z]+|[0-9]+|[_-]+")) - 1).cast("double")
        s2, s3 = (by_encoding(lambda x, i=i: class_moments(ENCODINGS[x][2])[i], e) for i in (0, 1))
        runs = (changes - (n - 1) * (1 - s2)) / F.sqrt((n - 1) * s2 * (1 - s2) + 2 * (n - 2) * (s3 - s2 * s2))
        mean, variance = (k - 1) / 2, (k * k - 1) / 12
        values = lambda part: F.transform(F.split(part, ""), lambda c: F.instr(v["alphabet"], c) - 1 - mean)
        products = lambda x: F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: p * q), F.lit(0.0), lambda acc, y: acc + y)
        parts = F.regexp_extract_all(u, F.lit(f"[\\s\\S]{{1,{PART}}}"), F.lit(0))
        sums = F.aggregate(F.transform(parts, lambda p: let(values(p), products)), F.lit(0.0), lambda acc, y: acc + y)
        pairs = n - F.ceil(n / PART)
        return F.struct(e.alias("encoding"), n.alias("n"), changes.alias("changes"), symbols.alias("symbols"), by_encoding(classes_of, e).alias("classes"), runs.alias("runs"), (sums / (variance * F.sqrt(pairs))).alias("serial"))

    return let(named, lambda v: let(formed(v), tested))


def step_of(b: Column) -> Column:
    """Steps of the chance, in an ordinary string, of so many changes of class; 0 (chance 1) where the run is structured."""
    up = lambda x: F.greatest(b[x], F.lit(0.0))
    largest = F.greatest(up("symbols"), up("classes"), F.abs(b["runs"]), F.abs(b["serial"]))
    total = up("symbols") * up("symbols") + up("classes") * up("classes") + b["runs"] * b["runs"] + b["serial"] * b["serial"]
    structured = (largest > REJECT) | (total > TOTAL)
    share = b["changes"] / (b["n"] - 1)
    changed, same = share * F.log(share / ORDINARY), F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - ORDINARY))).otherwise(0.0)
    steps = F.floor(STEPS_OF_TEN / math.log(10) * (b["n"] - 1) * (changed + same))
    return F.when(structured | (share <= ORDINARY), F.lit(0)).otherwise(F.least(steps, F.lit(LAST_STEP)).cast("int"))


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end of the known forms), runs (start, end, encoding, band, step of the candidates)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS[:3]:
        df = split_at(df, "text", PATTERNS[kind], least=LEAST[kind], name=kind)
    base = [as_spans(F.filter(kind, lambda m: m["ok"]), n) for n, kind in enumerate(KINDS[:3])]
    df = df.withColumn("base", F.array_sort(F.concat(*base))).withColumn("left", blanked("assign", "text")).select("doc_id", "base", "left")
    for kind in KINDS[1:3]:
        df = split_at(df, "left", PATTERNS[kind], least=LEAST[kind], name=kind).withColumn("left", blanked(kind, "left")).select("doc_id", "base", "left")
    df = split_at(df, "left", RUN, name="found")

    def candidate(m: Column) -> Column:
        held = lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), b["encoding"].alias("encoding"), F.floor(2 * F.log2(b["n"])).cast("int").alias("band"), step_of(b).alias("step"))
        return let(battery(m["hit"]), held)

    return df.select("doc_id", "base", F.transform("found", candidate).alias("runs"))


def least_steps(runs: DataFrame, fdr: float = FDR) -> DataFrame:
    """encoding, band, least: the smallest step that passes Benjamini and Hochberg's rule. A row for each encoding and half
    octave of length; the windows see one row for each of at most LAST_STEP steps."""
    counts = runs.groupBy("encoding", "band", "step").agg(F.count(F.lit(1)).alias("n"))
    stratum = Window.partitionBy("encoding", "band")
    up_to = F.sum("n").over(stratum.orderBy(F.desc("step")))
    passing = F.pow(F.lit(10.0), -F.col("step") / STEPS_OF_TEN) <= fdr * up_to / F.sum("n").over(stratum)
    return counts.withColumn("passing", passing & (F.col("step") > 0)).where("passing").groupBy("encoding", "band").agg(F.min("step").alias("least"))


def secrets(docs: DataFrame, *, fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans holds kind:start:end of all spans by start, kind and end, comma-joined (code points, end exclusive); base_sha256
    digests those of the known forms. Matches of a form do not overlap each other; those that fail a length go. Known forms
    found are overwritten by spaces, form after form, before candidates are looked for. Null and empty texts have no span;
    rows are judged each, repeated or not (copies of a run count each in the false-discovery control); a null doc_id stays
    null; an empty table gives no rows; other columns are ignored. Texts are taken whole, whatever their length.
    """
    found = written(scanned(docs))
    runs = found.select(F.explode("runs").alias("r")).select("r.encoding", "r.band", "r.step")
    least = least_steps(runs, fdr).collect()  # a row for each encoding and half octave of length
    pairs = [x for r in least for x in (F.lit(f"{r['encoding']}:{r['band']}"), F.lit(r["least"]))]
    limits = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,int>")
    limit = lambda r: F.coalesce(F.element_at(limits, F.concat_ws(":", r["encoding"], r["band"])), F.lit(LAST_STEP + 1))
    random = as_spans(F.filter("runs", lambda r: r["step"] >= limit(r)), 3)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    found = found.withColumn("random", random)
    return found.select("doc_id", *(of_kind(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])), F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
