"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmetrics.llm import (
    bbit_minhash,
    bpe_chunks,
    centroid_zones,
    chat_format,
    exact_dedup,
    jaccard_join,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring_dedup,
    vector_codes,
    vector_sql,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality_rules.score_rules(table(spark, folder, "documents"), trusted)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP2_SQL = r"""
with plain as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as plain from documents
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, sha256(plain) as text_sha256
from plain window same as (partition by plain)
"""


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_labels(license_scan.scan_licenses(table(spark, folder, "documents")))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "select cast(c as bigint) as conv_id, cast(t as bigint) as turn, r as role, s as text "
        f"from values (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') as v(c, t, r, s)"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.formatted_digest(chat_format.format_conversations(rows))


OP4_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
sized as (
    select *, row_number() over said as place, lag(role) over said as before,
           length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) as text_chars,
           length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) as role_chars
    from turns window said as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(text_chars + case when before = role then 7 else role_chars + 13 end) as bigint) as formatted_chars
from sized group by conv_id
"""

def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(table(spark, folder, "documents")))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = quality_classifier.held_out()
    labels = table(spark, folder, "labels").where(~held_out)
    scored = quality_classifier.score_quality(table(spark, folder, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents")).drop("key")


def op9_bpe_chunks(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe_chunks.encode_documents(table(spark, folder, "documents"), tokenizer)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
),
starts as (
    select doc_id, unnest(range(1, len(words) - 18)) as start, words from split where len(words) >= 20
),
wins as (select doc_id, start, array_to_string(words[start:start + 19], ' ') as win from starts),
named as (
    select doc_id, start from wins
    qualify row_number() over (partition by win order by doc_id, start) > 1
),
gone as (select distinct doc_id, unnest(range(start, start + 20)) as place from named),
lists as (select doc_id, list(place) as places, count(*) as n_removed from gone group by doc_id),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from split),
kept as (
    select doc_id, string_agg(word, ' ' order by place) as kept
    from each anti join gone using (doc_id, place) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from split left join lists using (doc_id) left join kept using (doc_id)
"""


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, folder, "embeddings")).drop("label")


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_zones.cluster_vectors(table(spark, folder, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bbit_minhash.near_components(table(spark, folder, "documents"))


OP13_SQL = r"""
with recursive split as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
    ) as words from documents
),
sets as (
    select distinct doc_id, array_to_string(words[start:start + 3], ' ') as shingle
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as start from split where len(words) > 0)
),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
    select a, b
    from (
        select l.doc_id as a, r.doc_id as b, count(*) as common
        from sets l join sets r on l.shingle = r.shingle and l.doc_id < r.doc_id group by l.doc_id, r.doc_id
    )
    join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 80 * (x.n + y.n - common)
),
either as materialized (select a, b from links union all select b, a from links),
reached as (
    select a as doc_id, a as other from (select distinct a from either)
    union
    select reached.doc_id, either.b from reached join either on either.a = reached.other
),
least_of as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id,
       coalesce(component_id, doc_id) = doc_id as kept
from split left join sizes using (doc_id) left join least_of using (doc_id)
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_bpe_chunks": op9_bpe_chunks,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_minhash_dedup": op13_minhash_dedup,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op3_license_scan": license_scan.oracle_sql(),
    "op4_chat_format": OP4_SQL,
    "op5_secret_scan": secret_scan.oracle_sql(),
    "op10_substring_dedup": OP10_SQL,
    "op11_vector_codes": vector_sql.codes_sql(parts=4, scale=1024, entries=256, rounds=4, width=16),
    "op12_centroid_clusters": vector_sql.clusters_sql(width=64, scale=64, clusters=16, rounds=3),
    "op13_minhash_dedup": OP13_SQL,
}
