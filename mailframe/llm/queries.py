"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, bpe, exact_dedup, language, line_dedup, mixing, near_dedup, quality, secret_scan, substring, topk, toxicity, whitening,
)
from .common import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = line_dedup.drop_lists(table(spark, sf_dir, "documents"))
    return lists.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(table(spark, sf_dir, "documents"), *paths)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.shifted_vectors(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_word_bpe": op5_word_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_language": op9_language,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_exact_dedup": """
        with norm as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
            from documents
        )
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id is not distinct from max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from norm
    """,
    "op10_exact_top_k": """
        with usable as (
            select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(coalesce(list_inner_product(q.v, c.v), 0) as bigint) as score
            from usable q join usable c on q.vec_id <> c.vec_id
            where q.vec_id % 20 = 0
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
                   vec_id, score
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op12_substring_dedup": r"""
        with texts as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
        ), windows as (
            select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from texts)
        ), firsts as (
            select g, min(doc_id) as first_id from windows group by g
        ), gone as (
            select distinct doc_id, i + k as place
            from windows join firsts using (g), range(0, 13) r(k)
            where first_id < doc_id
        ), kept as (
            select doc_id, count(*) as n, string_agg(word, ' ' order by place) as s
            from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from texts)
            anti join gone using (doc_id, place)
            group by doc_id
        )
        select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256
        from texts left join kept using (doc_id)
    """,
}
