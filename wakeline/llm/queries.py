"""The subpackage's registered queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .common import crc_rest
from .common import read as _read


#: For the registered query only, so that its reruns agree; not for data.
TEST_KEY = b"a key for tests"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return _read(spark, sf_dir, table)


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import sampled

    return sampled(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import linked

    return linked(read(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import counted

    return counted(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduped

    return deduped(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymised

    return pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), key=TEST_KEY)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identified, training_rows

    docs = read(spark, sf_dir, "documents")
    held_out = crc_rest("doc_id", 3) == 1
    model = fit(training_rows(docs, held_out))
    return identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import scored

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs.withColumn("held_out", crc_rest("doc_id", 7) == 2))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .randomness import secrets

    return secrets(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whitened

    return whitened(read(spark, sf_dir, "embeddings"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resampled

    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_llr, op2_piece_sampling, op3_mix_sources, op4_embedding_near_dedup, op5_token_counts, op6_suffix_dedup, op7_pii_pseudonyms, op8_minhash_near_dedup, op9_language_id, op10_context_tree, op11_secret_scan, op12_embedding_whitening, op13_target_resampling, pipeline)
}
#: SQL where it can express an operator; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": """with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
 reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
 comp as (select a as vec_id, min(b) as component_id from reach group by a), n as (select a as vec_id, count(*) as n_links from links group by a)
 select e.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = e.vec_id as kept from embeddings e join comp using (vec_id) left join n using (vec_id)""",
    "op6_suffix_dedup": """with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n_bytes from documents),
 p as (select doc_id, b, n_bytes, unnest(range(n_bytes)) as i from d), w as (select doc_id, i, case when i + 50 <= n_bytes then array_slice(b, i + 1, i + 50) end as m, hex(array_slice(b, i + 1, i + 1)) as byte from p),
 least as (select m, min(doc_id) as first from w where m is not null group by m),
 hit as (select w.doc_id, i, byte, coalesce(first < w.doc_id, false) as starts from w left join least on w.m = least.m),
 gone as (select doc_id, i, byte, max(starts::int) over (partition by doc_id order by i rows between 49 preceding and current row) as r from hit),
 edge as (select *, lag(r, 1, 0) over (partition by doc_id order by i) as before from gone),
 g as (select doc_id, sum(r)::bigint as n_removed, sum((r = 1 and before = 0)::int)::bigint as n_spans, coalesce(string_agg(byte, '' order by i) filter (where r = 0), '') as kept from edge group by doc_id)
 select d.doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join g using (doc_id)""",
    "op13_target_resampling": r"""with recursive crc(i, c) as (select i, list_reduce([i] || range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) from range(256) t(i)),
 table_ as (select list(c order by i) as crcs from crc),
 texts as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 target as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
 raw as (select doc_id, unnest(w) as word from texts), vocabulary as (select word from raw union select word from target),
 bytes as (select word, list_transform(range(1, octet_length(encode(word)) + 1), lambda k: ('0x' || hex(array_slice(encode(word), k, k)))::bigint) as b from vocabulary),
 bucket as (select word, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, table_),
 s as (select bucket, count(*) as s from raw join bucket using (word) group by all), t as (select bucket, count(*) as t from target join bucket using (word) group by all),
 total as (select (select coalesce(sum(s), 0) from s)::double as all_s, (select coalesce(sum(t), 0) from t)::double as all_t),
 gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000) / ((coalesce(s, 0) + 1)::double * (all_t + 10000))))::bigint as gain from (select distinct bucket from bucket) left join s using (bucket) left join t using (bucket), total),
 weights as (select doc_id, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from raw join bucket using (word) join gain using (bucket) group by doc_id),
 scored as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::bigint + 0.5::double) / 4294967296::double))))::bigint as score from documents left join weights using (doc_id)),
 ordered as (select doc_id, row_number() over (order by score desc, doc_id) as r, 10 * count(*) over () // 100 as k from scored where n_features >= 20)
 select doc_id, n_features, weight, score, case when r <= k then r end::bigint as rank from scored left join ordered using (doc_id)""",
}
