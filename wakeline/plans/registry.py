"""Registered queries and their equivalent SQL. The driver's events play the position reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import events as E
from ..operators import explain, iforest, prepare, ranking, reports, rules, vessel_udtf
from ..operators import trajectory as T
from ..operators.lstm import Lstm
from ..shipping import ship
from ..sources import ais, shared
from ..sources import points as P
from . import sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLEET = ("sog_curr", "abs_dsog", "abs_dcog", "delta_t_s", "delta_t_min", "dist_m", "implied_kts")
MODEL_FEATURES = ("delta_t_s", "dist_m", "dsog", "dcog", "dheading", "sog_curr")
SEQ_LEN = 10
N_EVENTS = 20


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r(c: str | Column, places: int) -> Column:
    """Rounded, with one zero only."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(points(spark, sf_dir))


def fleet(df: DataFrame) -> DataFrame:
    found = stats.fleet_stats(df, FLEET)
    return found.select("feature", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir)
    return rules.classify(df, rules.thresholds(fleet(df), "p95"))


# The SQL of the shared steps.
SQL_POINTS = """points as (select event_id, user_id as mmsi, epoch_us(ts) // 60000000 as t_s,
  25 + user_id % 20 + (event_id * 7919 % 1000) / 10000e0 as lat, -90 + user_id % 30 + (event_id * 104729 % 1000) / 10000e0 as lon, value / 10 as sog,
  case when event_id % 50 = 0 then null else ((k * 73 + event_id * 17) % 3600) / 10e0 end as cog, (case when k % 10 = 0 then 511 else k * 37 % 360 end)::double as heading,
  (event_type = 'error')::int as is_anomaly, (user_id % 5)::int as vessel_type
  from (select *, json_extract_string(props, '$.k')::bigint as k from events))"""


def sql_wrap(a: str, b: str) -> str:
    x = f"(({b} - {a} + 180e0) % 360e0)"
    return f"(case when {x} < 0 then ({x} + 360e0) % 360e0 else {x} end - 180e0)"  # of -1e-14 and 360 the sum is 360, so a half turn stays -180


def sql_turn(a: str, b: str) -> str:
    x = f"round({sql_wrap(a, b)}, 6)"
    return f"case when {x} >= 180 then {x} - 360e0 else {x} end"


def sql_distance(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0e0))))"


SQL_PAIRS = f"""{SQL_POINTS}, lagged as (select *, lag(t_s) over w as p_t, lag(lat) over w as p_lat, lag(lon) over w as p_lon, lag(sog) over w as p_sog, lag(cog) over w as p_cog, lag(heading) over w as p_heading
  from points window w as (partition by mmsi order by t_s, event_id)),
 raw as (select event_id, mmsi, vessel_type, p_t as t_prev, t_s as t_curr, (t_s - p_t)::double as delta_t_s, (t_s - p_t)::double / 60 as delta_t_min, round({sql_distance("p_lat", "p_lon", "lat", "lon")}, 3) as dist_m,
  round(sog - p_sog, 6) as dsog, {sql_turn("p_cog", "cog")} as dcog, {sql_turn("p_heading", "heading")} as dheading, sog as sog_curr, cog as cog_curr from lagged where p_t is not null),
 pairs as (select *, abs(dsog) as abs_dsog, abs(dcog) as abs_dcog, abs(dheading) as abs_dheading, case when delta_t_s <> 0 then round(dist_m / delta_t_s + 1e-9, 6) end as implied_mps,
  case when delta_t_s <> 0 then round(dist_m / delta_t_s * 1.943844e0 + 1e-9, 6) end as implied_kts from raw)"""
PAIR_COLUMNS = "event_id, mmsi, vessel_type, t_prev, t_curr, delta_t_s, delta_t_min, dist_m, dsog, dcog, dheading, sog_curr, cog_curr, abs_dsog, abs_dcog, abs_dheading, implied_mps, implied_kts"
SQL_FLEET = " union all ".join(f"select '{c}' as feature, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.95), 6) as p95, round(quantile_cont({c}, 0.99), 6) as p99, round(quantile_cont({c}, 0.999), 6) as p999, round(max({c}), 6) as max from pairs" for c in FLEET)


def sql_limit(feature: str) -> str:
    return f"(select p95 from fleet where feature = '{feature}')"


# Written out by hand, so that it tests the table of rules.
SQL_CLASSIFIED = f"""{SQL_PAIRS}, fleet as ({SQL_FLEET}), p95 as (select {sql_limit("sog_curr")} as sog, {sql_limit("abs_dsog")} as p95_dsog, {sql_limit("abs_dcog")} as p95_dcog, {sql_limit("delta_t_s")} as gap, {sql_limit("dist_m")} as dist, {sql_limit("implied_kts")} as kts),
 zeroed as (select pairs.*, p95.*, coalesce(sog_curr, 0) as z_sog, coalesce(abs_dsog, 0) as z_dsog, coalesce(abs_dcog, 0) as z_dcog, coalesce(delta_t_s, 0) as z_gap, coalesce(dist_m, 0) as z_dist, coalesce(implied_kts, 0) as z_kts from pairs, p95),
 marked as (select *, z_sog > sog or z_dsog > p95_dsog as cat_speed, z_dcog > p95_dcog as cat_turn, z_gap > gap as cat_timegap, z_dist > dist or z_kts > kts as cat_distance,
  round_even(greatest(0e0, z_sog / greatest(sog, 1e-9), z_dsog / greatest(p95_dsog, 1e-9)), 4) as cat_score_speed, round_even(greatest(0e0, z_dcog / greatest(p95_dcog, 1e-9)), 4) as cat_score_turn,
  round_even(greatest(0e0, z_gap / greatest(gap, 1e-9)), 4) as cat_score_timegap, round_even(greatest(0e0, z_dist / greatest(dist, 1e-9), z_kts / greatest(kts, 1e-9)), 4) as cat_score_distance from zeroed),
 classified as (select *, coalesce(nullif(concat_ws(',', case when cat_speed then 'speed' end, case when cat_turn then 'turn' end, case when cat_timegap then 'timegap' end, case when cat_distance then 'distance' end), ''), 'unclassified') as categories,
  cat_speed::int + cat_turn::int + cat_timegap::int + cat_distance::int as n_categories from marked)"""  # fmt: skip


@query("ais_points", f"with {SQL_POINTS} select * from points")
def ais_points(spark, d):
    return points(spark, d)


@query("pair_features", f"with {SQL_PAIRS} select {PAIR_COLUMNS} from pairs")
def pair_features(spark, d):
    return pairs(spark, d).select(*PAIR_COLUMNS.split(", "))


DIRTY = {
    "MMSI": "case when event_id % 13 = 0 then 'x' else cast(user_id as string) end",
    "BaseDateTime": "case when event_id % 7 = 0 then 'yesterday' when event_id % 7 = 1 then '2024-12-25 10:' || lpad(cast(event_id % 60 as string), 2, '0') || ':07' else ' 2024-12-26T03:' || lpad(cast(event_id % 60 as string), 2, '0') || ':59 ' end",
    "LAT": "case when event_id % 11 = 0 then 'abc' else cast(event_id % 90 as string) end",
    "LON": "case when event_id % 17 = 0 then '' else cast(event_id % 180 as string) || '.5' end",
    "SOG": "case when event_id % 5 = 0 then '' when event_id % 19 = 0 then ' ' else cast(event_id % 60 as string) end",
    "COG": "case when event_id % 3 = 0 then '' else cast(event_id % 360 as string) end",
    "Heading": "case when event_id % 4 = 0 then '511' else cast(event_id % 360 as string) end",
}
SQL_DIRTY = ", ".join(f"{v.replace('as string', 'as varchar')} as {k}" for k, v in DIRTY.items())


@query("points_clean_reject", f"""with dirty as (select {SQL_DIRTY} from events), typed as (select try_cast(trim(MMSI) as bigint) as mmsi,
 epoch_us(coalesce(try_strptime(trim(BaseDateTime), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(BaseDateTime), '%Y-%m-%d %H:%M:%S'))) / 1e6 as t_s, try_cast(LAT as double) as lat, try_cast(LON as double) as lon,
 case when SOG = '' then 0e0 else try_cast(SOG as double) end as sog, try_cast(COG as double) as cog, try_cast(Heading as double) as heading from dirty)
 select * from typed where mmsi is not null and t_s is not null and lat is not null and lon is not null and sog is not null""")  # fmt: skip
def points_clean_reject(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr(*(f"{v} as {k}" for k, v in DIRTY.items()))
    return P.typed_points(raw).drop("ts")


#: The dirty reports as CSV records: names with line ends in quotes, and bytes that are not UTF-8.
CSV_HEADER = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,Name"
CSV_NAME = "case when event_id % 23 = 0 then concat('n', cast(unhex('ff') as string), 'x') when event_id % 29 = 0 then '\"two\\nlines, \"\"quoted\"\"\"' when event_id % 31 = 0 then 'Ærø' else 'plain' end"
SQL_READ = f"""dirty as (select event_id, {SQL_DIRTY} from events), typed as (select event_id, try_cast(trim(MMSI) as bigint) as mmsi,
 epoch_us(coalesce(try_strptime(trim(BaseDateTime), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim(BaseDateTime), '%Y-%m-%d %H:%M:%S'))) / 1e6 as t_s, try_cast(LAT as double) as lat, try_cast(LON as double) as lon,
 case when SOG = '' then 0e0 else try_cast(SOG as double) end as sog, case when trim(COG) = '' then 0e0 else try_cast(COG as double) end as cog from dirty),
 judged as (select *, case when mmsi is null then 'MMSI is no number' when t_s is null then 'BaseDateTime is no time' when lat is null then 'LAT is no number' when lon is null then 'LON is no number' when sog is null then 'SOG is no number' when cog is null then 'COG is no number' end as reason from typed)"""


def _csv(spark, d) -> str:
    """The events as dirty CSV files below a folder of the shared directory."""
    cells = [f"cast({v} as string)" for v in DIRTY.values()]
    line = f"concat_ws(',', {', '.join(cells)}, {CSV_NAME})"
    numbered = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{line} as line")
    path = shared.shared_path(spark, f"wakeline-{uuid.uuid4().hex}")
    # the header comes first in each file
    rows = numbered.repartition(4, "event_id").withColumn("file", F.spark_partition_id())
    header = spark.range(4).select(F.lit(-1).cast("long").alias("event_id"), F.lit(CSV_HEADER).alias("line"), F.col("id").cast("int").alias("file"))
    rows.unionByName(header).repartition(4, "file").sortWithinPartitions("file", "event_id").select("file", "line").write.partitionBy("file").text(path)
    return path


def _csv_points(spark, d, mode):
    ship(spark)
    return ais.read(spark, _csv(spark, d), mode, split_bytes=100_000)


@query("points_strict", f"with {SQL_READ} select mmsi, t_s, lat, lon, sog, cog from judged where reason is null and event_id % 23 <> 0")
def points_strict(spark, d):
    return _csv_points(spark, d, "strict")[0]


@query("points_lenient", f"with {SQL_READ} select mmsi, t_s, lat, lon, sog from judged where coalesce(reason, 'COG') like 'COG%'")
def points_lenient(spark, d):
    return _csv_points(spark, d, "lenient")[0]


@query("points_rejected", f"with {SQL_READ}, all_ as (select case when event_id % 23 = 0 then 'not UTF-8' else reason end as reason from judged) select reason, count(*) as n from all_ where reason is not null group by reason")
def points_rejected(spark, d):
    return _csv_points(spark, d, "strict")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("prep_constant_columns", f"with {SQL_PAIRS}, x as (select *, 7e0 as seven, case when event_id % 2 = 0 then 1e0 end as half, cast(null as double) as nothing from pairs) " + " union all ".join(f"select '{c}' as feature, count(distinct {c}) <= 1 as constant, count(distinct {c}) + (count(*) > count({c}))::int <= 1 as constant_with_nulls from x" for c in (*MODEL_FEATURES, "seven", "half", "nothing")))
def prep_constant_columns(spark, d):
    df = pairs(spark, d).withColumns({"seven": F.lit(7.0), "half": F.when(F.col("event_id") % 2 == 0, 1.0), "nothing": F.lit(None).cast("double")})
    names = [*MODEL_FEATURES, "seven", "half", "nothing"]
    strict = prepare.constant_columns(df, names, nulls_count=True).withColumnRenamed("constant", "constant_with_nulls")
    return prepare.constant_columns(df, names).join(strict, "feature")


SQL_IMPUTED = ", ".join(f"coalesce({c}, (select quantile_cont({c}, 0.5) from logged), 0) as {c}" for c in MODEL_FEATURES)
# Moments from exact sums of whole steps from the median, 2^40 of them to the farthest value: sums of doubles hang on the order of the rows.
SQL_MEDIANS = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) as md_{c}" for c in MODEL_FEATURES)
SQL_STEP = ", ".join(f"(select nullif(max(abs({c} - md_{c})), 0) / 1099511627776e0 from filled, medians) as u_{c}" for c in MODEL_FEATURES)
SQL_STEPS = ", ".join(f"floor(({c} - md_{c}) / u_{c} + 0.5e0)::hugeint as k_{c}" for c in MODEL_FEATURES)
SQL_SUMS = ", ".join(f"coalesce(sum(k_{c}), 0)::double as s_{c}, coalesce(sum(k_{c} * k_{c}), 0)::double as q_{c}" for c in MODEL_FEATURES)
SQL_MOMENTS = ", ".join(f"md_{c} + s_{c} / n * coalesce(u_{c}, 0) as mean_{c}, coalesce(nullif(sqrt((q_{c} - s_{c} * s_{c} / n) / nullif(n - 1, 0)) * u_{c}, 0), 1) as std_{c}" for c in MODEL_FEATURES)
SQL_SCALER = f"medians as (select {SQL_MEDIANS} from logged), step as (select {SQL_STEP}), steps as (select {SQL_STEPS} from filled, medians, step), sums as (select count(*) as n, {SQL_SUMS} from steps), scaler as (select {SQL_MOMENTS} from sums, medians, step)"
SQL_Z = ", ".join(f"round(({c} - mean_{c}) / std_{c}, 4) + 0e0 as {c}" for c in MODEL_FEATURES)


@query("prep_impute_zscore", f"with {SQL_PAIRS}, logged as (select event_id, mmsi, t_prev, t_curr, {', '.join('ln(1 + dist_m) as dist_m' if c == 'dist_m' else c for c in MODEL_FEATURES)} from pairs), filled as (select event_id, mmsi, t_prev, t_curr, {SQL_IMPUTED} from logged), {SQL_SCALER} select event_id, mmsi, t_prev, t_curr, {SQL_Z} from filled, scaler")
def prep_impute_zscore(spark, d):
    out, _ = prepare.prepare_features(pairs(spark, d).select("event_id", *prepare.META, *MODEL_FEATURES), carry=("event_id",))
    return out.select("event_id", *prepare.META, *(r(c, 4).alias(c) for c in MODEL_FEATURES))


@query("forest_train_clean", f"""with {SQL_PAIRS}, x as (select event_id, case when event_id % 3 = 0 then 'abc' else dist_m::varchar end as dist_m, dsog, 0e0 as zero, case when event_id % 2 = 0 then 0e0 end as half from pairs)
 select event_id, coalesce(try_cast(dist_m as double), 0) as dist_m, coalesce(dsog, 0) as dsog from x""")
def forest_train_clean(spark, d):
    df = pairs(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "abc").otherwise(F.col("dist_m").cast("string")).alias("dist_m"), "dsog", F.lit(0.0).alias("zero"), F.when(F.col("event_id") % 2 == 0, 0.0).alias("half"))
    return prepare.training_table(df, ["dist_m", "dsog", "zero", "half"], ["event_id"])[0]


@query("missing_count", f"with {SQL_PAIRS} select " + " + ".join(f"count(*) - count({c})" for c in MODEL_FEATURES) + " as n_missing from pairs")
def missing_count(spark, d):
    return prepare.missing_count(pairs(spark, d), list(MODEL_FEATURES))


@query("fleet_reference_stats", f"with {SQL_PAIRS} {SQL_FLEET}")
def fleet_reference_stats(spark, d):
    return fleet(pairs(spark, d))


@query("score_summary", f"with {SQL_PAIRS} select round(min(dist_m), 4) as min, " + ", ".join(f"round(quantile_cont(dist_m, {q}), 4) as {n}" for n, q in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + ", round(max(dist_m), 4) as max, round(avg(dist_m), 4) as mean, round(coalesce(stddev_samp(dist_m), 0), 4) as std from pairs")
def score_summary(spark, d):
    out = stats.score_summary(pairs(spark, d), "dist_m")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def _top(rule: str) -> str:
    return f"with {SQL_PAIRS}, o as (select event_id, mmsi, dist_m, row_number() over (order by dist_m desc, event_id) as rank, count(*) over () as n from pairs) select event_id, mmsi, dist_m, rank from o where rank <= greatest(1, {rule}(n * 0.01))"


def _order(*keys: str) -> list[Column]:
    return [F.desc("dist_m"), *map(F.col, keys or ("event_id",))]


@query("top_fraction_ceil", _top("ceil"))
def top_fraction_ceil(spark, d):
    return ranking.top_fraction(pairs(spark, d).select("event_id", "mmsi", "dist_m"), _order(), 0.01, "ceil")[0]


@query("top_fraction_floor", _top("floor"))
def top_fraction_floor(spark, d):
    return ranking.top_fraction(pairs(spark, d).select("event_id", "mmsi", "dist_m"), _order(), 0.01, "floor")[0]


EXPLAINED = "anomaly_rank, anomaly_rank_pct, anomaly_score, mmsi, t_prev, t_curr, vessel_type, delta_t_s, dist_m, implied_kts, dsog, abs_dsog, dcog, abs_dcog"


@query("explain_join", f"""with {SQL_PAIRS}, o as (select mmsi, t_prev, t_curr, dist_m as anomaly_score, row_number() over (order by dist_m desc, event_id) as rk, count(*) over () as n from pairs),
 top as (select * from o where rk <= greatest(1, ceil(n * 0.01))), j as (select top.anomaly_score, p.* from top left join pairs p on top.mmsi is not distinct from p.mmsi and top.t_prev is not distinct from p.t_prev and top.t_curr is not distinct from p.t_curr)
 select row_number() over (order by anomaly_score desc, event_id) as anomaly_rank, round(row_number() over (order by anomaly_score desc, event_id) / count(*) over ()::double, 6) as anomaly_rank_pct, anomaly_score, mmsi, t_prev, t_curr, vessel_type, delta_t_s, dist_m, implied_kts, dsog, abs_dsog, dcog, abs_dcog from j""")  # fmt: skip
def explain_join(spark, d):
    df = pairs(spark, d)
    top = ranking.top_fraction(df, _order(), 0.01, "ceil")[0].select(*prepare.META, F.col("dist_m").alias("anomaly_score"))
    out = explain.explain_table(top, df, [F.desc("anomaly_score"), F.col("event_id")])
    return out.withColumn("anomaly_rank_pct", F.round("anomaly_rank_pct", 6)).select(*EXPLAINED.split(", "))


@query("explain_null_keys", f"""with {SQL_PAIRS}, a as (select case when event_id % 40 = 0 then null else mmsi end as mmsi, t_curr, event_id as top_id from pairs),
 b as (select case when event_id % 40 = 0 then null else mmsi end as mmsi, t_curr, dist_m from pairs) select a.mmsi, a.t_curr, top_id, dist_m, b.t_curr is not null as matched from a left join b on a.mmsi is not distinct from b.mmsi and a.t_curr is not distinct from b.t_curr""")  # fmt: skip
def explain_null_keys(spark, d):
    df = pairs(spark, d).withColumn("mmsi", F.when(F.col("event_id") % 40 == 0, None).otherwise(F.col("mmsi")))
    top = df.select("mmsi", "t_curr", F.col("event_id").alias("top_id"))
    return explain.explain_join(top, df.select("mmsi", "t_curr", "dist_m"), ("mmsi", "t_curr")).select("mmsi", "t_curr", "top_id", "dist_m", "matched")


@query("explain_unmatched", f"with {SQL_PAIRS}, a as (select mmsi, t_curr + (event_id % 2) * 100000000 as t_curr from pairs) select count(*) - sum((exists (select 1 from pairs b where b.mmsi = a.mmsi and b.t_curr = a.t_curr))::int) as n_unmatched from a")
def explain_unmatched(spark, d):
    df = pairs(spark, d)
    top = df.select("mmsi", (F.col("t_curr") + (F.col("event_id") % 2) * 100000000).alias("t_curr"))
    return explain.unmatched_count(explain.explain_join(top, df.select("mmsi", "t_curr").distinct(), ("mmsi", "t_curr")))


CATEGORIES = ("speed", "turn", "timegap", "distance")
CATS = "cat_speed, cat_turn, cat_timegap, cat_distance"


@query("classify_labels", f"with {SQL_CLASSIFIED} select event_id, {CATS}, categories, n_categories from classified")
def classify_labels(spark, d):
    return classified(spark, d).select("event_id", *CATS.split(", "), "categories", "n_categories")


@query("classify_scores", f"with {SQL_CLASSIFIED}, x as (" + " union all ".join(f"select event_id, '{n}' as category, cat_score_{n} as category_score from classified where cat_{n}" for n in CATEGORIES) + ") select *, round_even(100 * (rank() over (partition by category order by category_score) + (count(*) over (partition by category, category_score) - 1) / 2e0) / count(*) over (partition by category), 2) as percentile_rank from x")
def classify_scores(spark, d):
    return rules.category_rows(classified(spark, d)).select("event_id", "category", "category_score", "percentile_rank")


SQL_DIRTY_PAIRS = """dirty as (select event_id, case when event_id % 6 = 0 then 'nan'::double when event_id % 6 = 1 then 'inf'::double else sog_curr end as sog_curr, case when event_id % 7 = 0 then 'fast' when event_id % 7 = 1 then '' when event_id % 7 = 2 then 'NaN' else abs_dsog::varchar end as abs_dsog, abs_dcog, delta_t_s from pairs),
 zeroed as (select event_id, case when isfinite(sog_curr) then sog_curr else 0 end as sog, case when isfinite(try_cast(abs_dsog as double)) then try_cast(abs_dsog as double) else 0 end as dsog, coalesce(abs_dcog, 0) as dcog from dirty)"""
DIRTY_LIMITS = {"sog_curr": 31.7, "abs_dsog": 19.3, "abs_dcog": 90.0, "dist_m": 100.0, "implied_kts": None}


@query("classify_dirty", f"""with {SQL_PAIRS}, {SQL_DIRTY_PAIRS} select event_id, sog > 31.7e0 or dsog > 19.3e0 as cat_speed, dcog > 90 as cat_turn, false as cat_distance, round_even(greatest(sog / 31.7e0, dsog / 19.3e0), 4) as cat_score_speed,
 (sog > 31.7e0 or dsog > 19.3e0)::int + (dcog > 90)::int as n_categories from zeroed""")  # fmt: skip
def classify_dirty(spark, d):
    """Features that are NaN, infinite, text that is no number, or not there at all count as 0."""
    sog = F.when(F.col("event_id") % 6 == 0, float("nan")).when(F.col("event_id") % 6 == 1, float("inf")).otherwise(F.col("sog_curr"))
    text = F.when(F.col("event_id") % 7 == 0, "fast").when(F.col("event_id") % 7 == 1, "").when(F.col("event_id") % 7 == 2, "NaN").otherwise(F.col("abs_dsog").cast("string"))
    dirty = pairs(spark, d).select("event_id", sog.alias("sog_curr"), text.alias("abs_dsog"), "abs_dcog", "delta_t_s")
    return rules.classify(dirty, DIRTY_LIMITS).select("event_id", "cat_speed", "cat_turn", "cat_distance", "cat_score_speed", "n_categories")


@query("classify_summary", f"with {SQL_CLASSIFIED} " + " union all ".join(f"select '{n}' as category, coalesce(sum(({c})::int), 0)::bigint as n, round_even(100 * coalesce(sum(({c})::int), 0)::double / greatest(count(*), 1), 2) as pct from classified" for n, c in [*((n, f"cat_{n}") for n in CATEGORIES), ("unclassified", "n_categories = 0")]))
def classify_summary(spark, d):
    return rules.category_summary(classified(spark, d))


SQL_TWO = "(select printf('%.2f', p95) from fleet where feature = '{}')"
SQL_RULE_ROWS = [
    ("speed", "cat_speed", f"'sog_curr > ' || {SQL_TWO.format('sog_curr')} || ', abs_dsog > ' || {SQL_TWO.format('abs_dsog')}", "high reported SOG or sudden speed change (sog_curr or |dsog| > fleet p95)", "multi-label (OR)"),
    ("turn", "cat_turn", f"'abs_dcog > ' || {SQL_TWO.format('abs_dcog')}", "large course change (|dcog| > fleet p95)", "multi-label (OR)"),
    ("timegap", "cat_timegap", f"'delta_t_s > ' || {SQL_TWO.format('delta_t_s')}", "long gap between pings (delta_t_s > fleet p95)", "multi-label (OR)"),
    ("distance", "cat_distance", f"'dist_m > ' || {SQL_TWO.format('dist_m')} || ', implied_kts > ' || {SQL_TWO.format('implied_kts')}", "large position jump (dist_m or implied_kts > fleet p95)", "multi-label (OR)"),
    ("unclassified", "n_categories = 0", "'-'", "no single feature exceeds fleet threshold", "-"),
]


@query("classify_summary_table", f"with {SQL_CLASSIFIED} " + " union all ".join(f"select '{n}' as category, coalesce(sum(({c})::int), 0)::bigint as n_anomalies, round_even(100 * coalesce(sum(({c})::int), 0)::double / greatest(count(*), 1), 2) as pct_of_if_total, 'p95' as threshold_level, {t} as thresholds, '{text}' as rule_description, '{how}' as assignment from classified" for n, c, t, text, how in SQL_RULE_ROWS))
def classify_summary_table(spark, d):
    df = pairs(spark, d)
    limits = rules.thresholds(fleet(df), "p95")
    return rules.summary_table(rules.classify(df, limits), limits, "p95")


@query("multi_category_count", f"with {SQL_CLASSIFIED} select coalesce(sum((n_categories > 1)::int), 0)::bigint as n_multi from classified")
def multi_category_count(spark, d):
    return rules.multi_category_count(classified(spark, d))


SQL_BEST = f"{SQL_PAIRS}, best as (select *, row_number() over (partition by mmsi order by dist_m desc, event_id) as r from pairs), top as (select * from best where r = 1 order by dist_m desc, event_id limit {N_EVENTS})"


def _scored(spark, d) -> DataFrame:
    return pairs(spark, d).withColumn("anomaly_score", F.col("dist_m"))


@query("events_top_per_vessel", f"with {SQL_BEST} select event_id, mmsi, dist_m from top")
def events_top_per_vessel(spark, d):
    return E.top_events(_scored(spark, d), N_EVENTS, "event_id").select("event_id", "mmsi", "dist_m")


@query("events_remainder", f"with {SQL_BEST} select event_id, mmsi, dist_m from pairs where mmsi not in (select mmsi from top)")
def events_remainder(spark, d):
    df = _scored(spark, d)
    return E.remainder(df, E.top_events(df, N_EVENTS, "event_id")).select("event_id", "mmsi", "dist_m")


@query("events_sampled", f"""with {SQL_PAIRS}, best as (select *, row_number() over (partition by mmsi order by dist_m desc, event_id) as r from pairs), top as (select * from best where r = 1 order by dist_m desc, event_id limit 5),
 rest as (select * from pairs where mmsi not in (select mmsi from top) order by md5('42:' || event_id), event_id limit 5)
 select event_id, mmsi, dist_m, 'top' as sample_kind from top union all select event_id, mmsi, dist_m, 'random' from rest""")  # fmt: skip
def events_sampled(spark, d):
    return E.sample_events(_scored(spark, d), 5, 5, 42, "event_id").select("event_id", "mmsi", "dist_m", "sample_kind")


SQL_CONTEXT = f"""{SQL_BEST}, ev as (select event_id as key, mmsi, t_prev, t_curr, delta_t_s from top), ctx as (select ev.*, p.t_s as p_t, p.event_id as p_id, p.lat as p_lat, p.lon as p_lon, p.sog as p_sog, p.cog as p_cog
 from ev left join points p on p.mmsi = ev.mmsi and p.t_s between ev.t_prev - 3600 and ev.t_curr + 3600)"""


def _events(spark, d) -> DataFrame:
    return E.top_events(_scored(spark, d), N_EVENTS, "event_id").select(F.col("event_id").alias("key"), "mmsi", "t_prev", "t_curr", "delta_t_s")


def _context(spark, d) -> DataFrame:
    return E.segments(E.context(_events(spark, d), points(spark, d)))


@query("context_interval_join", f"with {SQL_CONTEXT} select key, mmsi, p_t, p_id, p_lat, p_lon, p_sog, p_cog from ctx")
def context_interval_join(spark, d):
    return E.context(_events(spark, d), points(spark, d)).select("key", "mmsi", "p_t", "p_id", "p_lat", "p_lon", "p_sog", "p_cog")


@query("context_segments", f"with {SQL_CONTEXT} select key, p_id, case when p_t < t_prev then 'before' when p_t <= t_curr then 'inside' when p_t > t_curr then 'after' end as segment, p_t <= t_prev as gap_before, p_t >= t_curr as gap_after, p_t >= t_curr as later from ctx")
def context_segments(spark, d):
    return _context(spark, d).select("key", "p_id", "segment", "gap_before", "gap_after", "later")


@query("context_pairwise_turn", f"""with {SQL_CONTEXT}, t as (select *, round(abs({sql_wrap("lag(p_cog) over w", "p_cog")}), 6) as abs_turn, count(p_t) over (partition by key) as n from ctx window w as (partition by key order by p_t, p_id)), i as (select * from t where n >= 3 and abs_turn is not null and p_t between t_prev and t_curr)
 select key, max(abs_turn) as peak, arg_max(p_t, abs_turn * 1e12 - p_t) as peak_t from i group by key""")  # fmt: skip
def context_pairwise_turn(spark, d):
    return E.peak(E.pairwise_turn(E.enough(_context(spark, d), "turn")), "abs_turn")


@query("context_speed_peak", f"""with {SQL_CONTEXT}, i as (select * from ctx where p_t between t_prev and t_curr and p_sog is not null) select key, max(p_sog) as peak, arg_max(p_t, p_sog * 1e12 - p_t) as peak_t, count(*) as n_inside from i group by key""")
def context_speed_peak(spark, d):
    """The speed figure's mark: the highest speed inside the event and its first time."""
    ctx = _context(spark, d)
    inside = ctx.where("segment = 'inside' and p_sog is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_inside"))
    return E.peak(ctx, "p_sog").join(inside, "key")


@query("figure_times", f"""with {SQL_CONTEXT} select key, t_prev + (t_curr - t_prev) / 2e0 as mid_s, strftime(to_timestamp(t_prev) at time zone 'UTC', '%H:%M') as from_hm, strftime(to_timestamp(floor(t_prev + (t_curr - t_prev) / 2e0)) at time zone 'UTC', '%H:%M') as mid_hm,
 strftime(to_timestamp(t_curr) at time zone 'UTC', '%H:%M') as to_hm, delta_t_s / 60 as minutes from ev""")  # fmt: skip
def figure_times(spark, d):
    """Where a silent period is marked: its middle, and clock times for the axis."""
    return E.time_marks(_events(spark, d)).select("key", "mid_s", "from_hm", "mid_hm", "to_hm", "minutes")


SQL_JUMP = f"""{SQL_CONTEXT}, b as (select key, arg_max(p_lat, p_t * 10000000 + p_id) as from_lat, arg_max(p_lon, p_t * 10000000 + p_id) as from_lon from ctx where p_t < t_prev group by key),
 i as (select key, arg_min(p_lat, p_t * 10000000 + p_id) as to_lat, arg_min(p_lon, p_t * 10000000 + p_id) as to_lon from ctx where p_t between t_prev and t_curr group by key)"""


@query("context_jump_km", f"with {SQL_JUMP} select key, round({sql_distance('from_lat', 'from_lon', 'to_lat', 'to_lon')} / 1000, 3) as jump_km from (select distinct key from ctx where p_t is not null) left join b using (key) left join i using (key)")
def context_jump_km(spark, d):
    ends = E.jump_ends(_context(spark, d).where("p_t is not null"))
    return E.with_jump_km(ends).select("key", F.round("jump_km", 3).alias("jump_km"))


@query("times_strict", """with dirty as (select event_id, case when event_id % 2 = 0 then '2024-12-25 10:' || lpad((event_id % 60)::varchar, 2, '0') || ':07' else '2024-12-25T10:' || lpad((event_id % 60)::varchar, 2, '0') || ':07' end as t from events)
 select event_id, epoch_us(try_strptime(t, '%Y-%m-%d %H:%M:%S')) / 1e6 as t_s from dirty where event_id % 2 = 0""")
def times_strict(spark, d):
    """The strict parse takes one format only, and stops at another; here it is given the rows that have it."""
    minute = F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    dirty = spark.read.parquet(f"{d}/events.parquet").where("event_id % 2 = 0").select("event_id", F.concat(F.lit("2024-12-25 10:"), minute, F.lit(":07")).alias("t"))
    return dirty.select("event_id", S.strict_epoch("t").alias("t_s"))


@query("context_pairwise_distance", f"with {SQL_CONTEXT} select key, p_id, round({sql_distance('lag(p_lat) over w', 'lag(p_lon) over w', 'p_lat', 'p_lon')}, 3) as segment_m from ctx window w as (partition by key order by p_t, p_id)")
def context_pairwise_distance(spark, d):
    return E.pairwise_distance(_context(spark, d)).select("key", "p_id", F.round("segment_m", 3).alias("segment_m"))


@query("context_speed_lines", f"with {SQL_CONTEXT}, fleet as ({SQL_FLEET}) select key, p_id, p_sog, (select p95 from fleet where feature = 'sog_curr') as line_p95, (select p99 from fleet where feature = 'sog_curr') as line_p99 from ctx")
def context_speed_lines(spark, d):
    return E.speed_lines(_context(spark, d), fleet(pairs(spark, d))).select("key", "p_id", "p_sog", "line_p95", "line_p99")


@query("context_jump_ends", f"""with {SQL_CONTEXT}, b as (select key, arg_max(p_lat, p_t * 10000000 + p_id) as from_lat, arg_max(p_lon, p_t * 10000000 + p_id) as from_lon from ctx where p_t < t_prev group by key),
 i as (select key, arg_min(p_lat, p_t * 10000000 + p_id) as to_lat, arg_min(p_lon, p_t * 10000000 + p_id) as to_lon from ctx where p_t between t_prev and t_curr group by key) select ev.key, from_lat, from_lon, to_lat, to_lon from ev left join b using (key) left join i using (key)""")  # fmt: skip
def context_jump_ends(spark, d):
    return E.jump_ends(_context(spark, d))


@query("timegap_bars", f"with {SQL_CONTEXT}, fleet as ({SQL_FLEET}) select key, 'fleet_median' as bar, (select p50 from fleet where feature = 'delta_t_s') / 60 as minutes from ev union all select key, 'fleet_p99', (select p99 from fleet where feature = 'delta_t_s') / 60 from ev union all select key, 'this', delta_t_s / 60 from ev")
def timegap_bars(spark, d):
    return E.gap_bars(_events(spark, d), fleet(pairs(spark, d)))


@query("manifest", f"""with {SQL_CONTEXT}, n as (select key, count(p_t) as n_context from ctx group by key), o as (select ev.*, row_number() over (order by delta_t_s desc, ev.key)::int as nth, n_context from ev join n using (key))
 select key, 'turn' as type, mmsi, t_prev, t_curr, null::double as anomaly_score, null::double as category_score, null::double as percentile_rank, 'top' as sample_kind, nth, n_context, case when n_context >= 3 then 'saved' else 'skipped (not enough context points)' end as status, case when n_context >= 3 then 'turn_top_' || lpad(nth::varchar, 3, '0') || '_mmsi_' || mmsi::varchar || '.png' else '' end as file from o""")  # fmt: skip
def manifest(spark, d):
    ev = _events(spark, d).withColumn("sample_kind", F.lit("top")).withColumn("score", F.col("delta_t_s"))
    return E.manifest(ev, points(spark, d), "turn")


SQL_SEQ = f"""{SQL_POINTS}, l as (select *, greatest((t_s - lag(t_s) over w)::double, 0) as dt0, lag(t_s) over w as p_t, row_number() over w as nth, count(*) over (partition by mmsi) as reports, coalesce(lat - lag(lat) over w, 0) as delta_lat, coalesce(lon - lag(lon) over w, 0) as delta_lon
  from points window w as (partition by mmsi order by t_s, event_id)), f as (select event_id, mmsi, t_s, lat, lon, sog as sog_raw, case when p_t is not null then dt0 end as dt, nth, least(greatest(sog, 0), 40) as sog,
  sin(radians(coalesce(cog, 0))) as cog_sin, cos(radians(coalesce(cog, 0))) as cog_cos, sin(radians(case when heading is null or heading = 511 then 0 else heading end)) as heading_sin, cos(radians(case when heading is null or heading = 511 then 0 else heading end)) as heading_cos,
  delta_lat, delta_lon, ln(1 + coalesce(case when p_t is not null then dt0 end, 0)) as log_delta_t from l where reports >= {SEQ_LEN + 2}),
 v as (select *, nth > {SEQ_LEN} and coalesce(max(dt) over (partition by mmsi order by t_s, event_id rows between {SEQ_LEN - 1} preceding and current row) <= 3600, false) as valid from f),
 c as (select *, sum(valid::int) over (partition by mmsi order by t_s, event_id rows between current row and {SEQ_LEN} following) as weight from v)"""
SQL_MEANS = ", ".join(f"sum(weight * {x}) / sum(weight) as m_{x}" for x in T.SEQ_FEATURES)
SQL_STDS = ", ".join(f"sqrt(sum(weight * ({x} - m_{x}) * ({x} - m_{x})) / sum(weight)) as s_{x}" for x in T.SEQ_FEATURES)
SQL_SCALER = f"{SQL_SEQ}, m as (select {SQL_MEANS} from c), s as (select {SQL_STDS} from c, m)"


@query("seq_features", f"with {SQL_SEQ} select event_id, mmsi, dt, nth, " + ", ".join(f"round({x}, 6) + 0e0 as {x}" for x in T.SEQ_FEATURES) + " from f")
def seq_features(spark, d):
    return T.core(T.sequence_features(points(spark, d))).select("event_id", "mmsi", "dt", F.col("nth").cast("long").alias("nth"), *(r(x, 6).alias(x) for x in T.SEQ_FEATURES))


@query("seq_valid_windows", f"with {SQL_SEQ} select mmsi, count(*) as n_reports, sum(valid::int)::bigint as n_windows, sum(weight)::bigint as coverage from c group by mmsi")
def seq_valid_windows(spark, d):
    c = T.window_coverage(sequence.windows_of(points(spark, d)))
    return c.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n_reports"), F.sum(F.col("valid").cast("long")).alias("n_windows"), F.sum("weight").alias("coverage"))


@query("seq_scaler_moments", f"with {SQL_SCALER} " + " union all ".join(f"select '{x}' as feature, round(m_{x}, 6) + 0e0 as mean, round(case when s_{x} < 1e-8 then 1 else s_{x} end, 6) as std from m, s" for x in T.SEQ_FEATURES))
def seq_scaler_moments(spark, d):
    out = T.scaler_moments(T.window_coverage(sequence.windows_of(points(spark, d))))
    return out.select("feature", r("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SQL_WINDOWS = f"{SQL_SCALER}, w as (select *, lag(t_s, {SEQ_LEN}) over (partition by mmsi order by t_s, event_id) as t_start, lag(t_s) over (partition by mmsi order by t_s, event_id) as t_prev, " + ", ".join(f"lag({x}) over (partition by mmsi order by t_s, event_id) as b_{x}" for x in T.SEQ_FEATURES) + " from v)"


@query("seq_metadata", f"with {SQL_WINDOWS} select event_id, mmsi, t_start, t_prev, t_s as t_curr, lat, lon, sog_raw as sog from w where valid")
def seq_metadata(spark, d):
    return T.sequences(sequence.windows_of(points(spark, d))).drop("seq")


def _sql_error(x: str) -> str:
    return f"power(({x} - b_{x}) / (case when s_{x} < 1e-8 then 1 else s_{x} end), 2)"


# Written out by hand, so that it tests the table of error groups.
SQL_ERRORS = f"""{_sql_error("sog")} as err_speed, {_sql_error("cog_sin")} + {_sql_error("cog_cos")} as err_course, {_sql_error("heading_sin")} + {_sql_error("heading_cos")} as err_heading,
 {_sql_error("delta_lat")} + {_sql_error("delta_lon")} as err_position_jump, {_sql_error("log_delta_t")} as err_time_gap"""
SQL_SCORED = f"{SQL_WINDOWS}, e as (select event_id, mmsi, {SQL_ERRORS}, ({' + '.join(_sql_error(x) for x in T.SEQ_FEATURES)}) / 8 as anomaly_score from w, s where valid)"
ERRS = ["err_speed", "err_course", "err_heading", "err_position_jump", "err_time_gap"]


def _seq_scores(spark, d) -> DataFrame:
    p = points(spark, d)
    return sequence.score(p, *sequence.scaler(sequence.windows_of(p)))


@query("seq_persistence_scores", f"with {SQL_SCORED} select event_id, mmsi, round(anomaly_score, 4) as anomaly_score, " + ", ".join(f"round({x}, 4) as {x}" for x in ERRS) + " from e")
def seq_persistence_scores(spark, d):
    return _seq_scores(spark, d).select("event_id", "mmsi", *(F.round(x, 4).alias(x) for x in ("anomaly_score", *ERRS)))


@query("seq_udtf", ORACLES["seq_persistence_scores"])
def seq_udtf(spark, d):
    """The persistence scores by the table function, called from SQL with the scaler's arrays."""
    ship(spark)
    p = points(spark, d)
    mean, std = sequence.scaler(sequence.windows_of(p))
    vessel_udtf.register(spark)
    numbers = lambda v: "array(" + ", ".join(f"{x!r}D" for x in v) + ")"
    scored = spark.sql(f"select * from score_vessel(table({{p}}) partition by mmsi order by (t_s, event_id), {numbers(mean)}, {numbers(std)})", p=p.select("event_id", "mmsi", "t_s", "lat", "lon", "sog", "cog", "heading"))
    return scored.select("event_id", "mmsi", *(F.round(x, 4).alias(x) for x in ("anomaly_score", *ERRS)))


SQL_LABEL = "case greatest(err_speed, err_course, err_heading, err_position_jump, err_time_gap) when err_speed then 'speed' when err_course then 'course' when err_heading then 'heading' when err_position_jump then 'position_jump' when err_time_gap then 'time_gap' end"
SQL_REASON = "case dominant_error when 'speed' then 'unexpected speed change' when 'course' then 'unexpected course change' when 'heading' then 'unexpected heading change' when 'position_jump' then 'unexpected position jump' when 'time_gap' then 'unexpected time gap pattern' end"
SQL_SEQ_TOP = f"{SQL_SCORED}, o as (select *, row_number() over (order by anomaly_score desc, mmsi, event_id) as rank, count(*) over () as n from e), t as (select event_id, mmsi, rank, round(anomaly_score, 4) as anomaly_score, round_even(100 * (1 - (rank - 1) / n::double), 4) as percentile_rank, {SQL_LABEL} as dominant_error from o where rank <= greatest(1, floor(n * 0.01)))"


@query("seq_top", f"with {SQL_SEQ_TOP} select *, {SQL_REASON} as reason_text from t")
def seq_top(spark, d):
    return sequence.top(_seq_scores(spark, d)).select("event_id", "mmsi", "rank", F.round("anomaly_score", 4).alias("anomaly_score"), "percentile_rank", "dominant_error", "reason_text")


@query("dominant_error_counts", f"with {SQL_SEQ_TOP}, x as (values ('speed'), ('course'), ('heading'), ('position_jump'), ('time_gap')) select col0 as dominant_error, count(event_id) as n, round_even(100 * count(event_id) / (select greatest(count(*), 1) from t)::double, 2) as pct from x left join t on dominant_error = col0 group by col0")
def dominant_error_counts(spark, d):
    return reports.dominant_counts(sequence.top(_seq_scores(spark, d)))


@query("seq_error_stats", f"with {SQL_SCORED} select round(min(anomaly_score), 4) as min, " + ", ".join(f"round(quantile_cont(anomaly_score, {q}), 4) as {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", round(max(anomaly_score), 4) as max, round(avg(anomaly_score), 4) as mean, round(stddev_pop(anomaly_score), 4) as std from e")
def seq_error_stats(spark, d):
    out = sequence.stats(_seq_scores(spark, d))
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("seq_error_bars", f"with {SQL_SCORED}, o as (select *, row_number() over (order by anomaly_score desc, mmsi, event_id) as rk from e), t as (select * from o where rk <= {N_EVENTS}) " + " union all ".join(f"select event_id as key, '{x}' as bar, round({x}, 4) as error from t" for x in ERRS))
def seq_error_bars(spark, d):
    top = ranking.top_rows(_seq_scores(spark, d), [F.desc("anomaly_score"), F.col("mmsi"), F.col("event_id")], N_EVENTS)
    return E.error_bars(top.withColumn("key", F.col("event_id"))).select("key", "bar", F.round("error", 4).alias("error"))


@query("vessel_sample", f"with {SQL_POINTS} select mmsi from (select distinct mmsi from points) order by md5('42:' || mmsi), mmsi limit 50")
def vessel_sample(spark, d):
    return ranking.sample_vessels(points(spark, d), 50, 42)


@query("train_val_split", f"with {SQL_PAIRS}, o as (select event_id, row_number() over (order by md5('42:' || event_id), event_id) as r, count(*) over () as n from pairs) select event_id, r <= floor(n * 0.15e0) as is_val from o")
def train_val_split(spark, d):
    return ranking.train_val_split(pairs(spark, d).select("event_id"), 0.15, 42, "event_id")


PINNED_FEATURES = ["delta_t_s", "dist_m", "abs_dsog", "sog_curr"]
PINNED_SIZE = 64


def pinned_forest() -> list[tuple]:
    """Ten small trees from seeded numbers in the range of the data."""
    x = np.random.Generator(np.random.PCG64(5)).random((PINNED_SIZE, 4)) * np.array([2000.0, 15000.0, 20.0, 40.0])
    return [n for t in range(10) for n in iforest.build_tree(np.round(x, 3), t, 7, 4)]


def _sql_walk() -> str:
    """The forest as a table of nodes, walked by a recursive query: nothing of the engine's own scoring is in it."""
    rows = ", ".join(f"({t}, {n}, {f}, {cut!r}e0, {left}, {right}, {size}, {depth})" for t, n, f, cut, left, right, size, depth in pinned_forest())
    x = " ".join(f"when {k} then p.{c}" for k, c in enumerate(PINNED_FEATURES))
    path = lambda n: f"(case when {n} <= 1 then 0e0 when {n} = 2 then 1e0 else 2 * (ln({n} - 1) + 0.5772156649e0) - 2 * ({n} - 1) / ({n})::double end)"
    return f"""with recursive {SQL_PAIRS}, nodes(tree, node, feature, cut, l, r, size, depth) as (values {rows}),
 walk(event_id, tree, node) as (select event_id, tree, 0 from pairs, (select distinct tree from nodes) union all
  select w.event_id, w.tree, case when (case n.feature {x} end) <= n.cut then n.l else n.r end from walk w join nodes n on n.tree = w.tree and n.node = w.node join pairs p on p.event_id = w.event_id where n.feature >= 0),
 z as (select event_id, power(2e0, -avg(depth + {path("size")}) / {path(str(PINNED_SIZE))}) as s from walk join nodes using (tree, node) where feature < 0 group by event_id)
 select event_id, round(s, 6) as anomaly_score, round(-s + 0.5e0, 6) + 0e0 as decision_function from z"""


@query("iforest_scores_pinned", _sql_walk())
def iforest_scores_pinned(spark, d):
    nodes = spark.createDataFrame(pinned_forest(), iforest.NODES)
    ship(spark)
    out = iforest.score(pairs(spark, d), nodes, {"features": PINNED_FEATURES, "max_samples": PINNED_SIZE})
    return out.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), r("decision_function", 6).alias("decision_function"))


@query("iforest_fit_score")
def iforest_fit_score(spark, d):
    ship(spark)
    x, _ = prepare.prepare_features(pairs(spark, d).select("event_id", *prepare.META, *MODEL_FEATURES), carry=("event_id",))
    nodes, meta = iforest.fit(x, list(MODEL_FEATURES), ["event_id"], n_trees=100)
    scores = iforest.score(x, nodes, meta).select("event_id", *prepare.META, "anomaly_score", "decision_function")
    return ranking.top_fraction(scores, [F.desc("anomaly_score"), F.col("event_id")], 0.01, "ceil")[0]


#: The registered model: all vessels and sequences, few epochs.
SEQ_MODEL = {"epochs": 4, "batch_size": 1024, "lr": 4e-3, "hidden": 32, "max_vessels": 1_000_000}


def _model(spark, d) -> tuple[Lstm, dict, dict[str, DataFrame]]:
    """The stored model of these reports (trained when there is none yet)."""
    ship(spark)
    return sequence.load(spark, sequence.fitted(points(spark, d), "registered", **SEQ_MODEL))


@query("seq_fit")
def seq_fit(spark, d):
    """The training log beside the loss of persistence on the same held-out sequences."""
    _, meta, tables = _model(spark, d)
    added = {"persistence_loss": meta["persistence_loss"], "n_train": meta["n_train"], "n_val": meta["n_val"]}
    return tables["log"].select("*", *(F.lit(v).alias(k) for k, v in added.items()))


@query("seq_thresholds")
def seq_thresholds(spark, d):
    """Quantiles and moments of the trained model's errors on the held-out sequences."""
    return _model(spark, d)[2]["thresholds"]


@query("lstm_scores")
def lstm_scores(spark, d):
    """Scores of all windows by the stored model, with the highest threshold that each exceeds."""
    model, meta, tables = _model(spark, d)
    scores = sequence.score(points(spark, d), meta["mean"], meta["std"], model)
    limits = tables["thresholds"].where("name in ('p90', 'p95', 'p99')").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("p90", "p95", "p99")))
    level = F.when(F.col("anomaly_score") > F.col("p99"), "p99").when(F.col("anomaly_score") > F.col("p95"), "p95").when(F.col("anomaly_score") > F.col("p90"), "p90")
    return scores.crossJoin(F.broadcast(limits)).withColumn("level", level).drop("p90", "p95", "p99")  # one row



