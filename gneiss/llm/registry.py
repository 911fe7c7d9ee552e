"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import alignment, bpe, exact_dedup, jaccard, mixing, periodic, pii, ppm, quality, sharding, token_counts, topk, toxicity
from gneiss.llm.scratch import stored


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.train(docs, _labels(spark, sf_dir)))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op3_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_docs(spark, sf_dir))


def op4_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return pii.find(docs, pii.train(docs)).drop("redacted")


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op7_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_docs(spark, sf_dir))


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A query has an index of its own, which goes once the result is written.
    docs = _docs(spark, sf_dir)
    with exact_dedup.DigestIndex(spark, buckets=exact_dedup.buckets_for(docs.count())) as index:
        return stored(exact_dedup.deduplicate(docs, index))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.runs(periodic.with_periodic_tail(_docs(spark, sf_dir))))


QUERIES = {
    "op1_attention_quality": op1_attention_quality,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_heavy_light_jaccard": op3_heavy_light_jaccard,
    "op4_uniform_threshold": op4_uniform_threshold,
    "op5_bilstm_crf_pii": op5_bilstm_crf_pii,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_partial_matching": op7_partial_matching,
    "op8_digest_index": op8_digest_index,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_pivotal_mix": op10_pivotal_mix,
    "op11_interval_alignment": op11_interval_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op4_uniform_threshold": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
    "op8_digest_index": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
