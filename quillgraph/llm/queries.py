"""The queries of this package and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import fingerprints, hamming, mixing, packing, passages, phrases, pii, resampling, sharding, simhash, suffixes, toxicity, urls
from quillgraph.llm.common import table

#: Bytes of text that a shard holds at most.
SHARD_LIMIT = 1 << 20
#: Rows whose id this divides ask, and how many answers each gets.
QUERY_EVERY, TOP_K = 50, 10
#: Rules of the URL filter query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_LIMIT)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, TOP_K)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_mixing, op3_url_filters, op4_substring_dedup, op5_topk_search, op6_fingerprints, op7_pii, op8_toxicity, op9_simhash, op10_packing, op11_suffix_dedup, op12_phrase_mining, op13_importance_resampling)}

ORACLES = {
    "op11_suffix_dedup": suffixes.sql(),
    "op12_phrase_mining": phrases.sql(),
    "op13_importance_resampling": resampling.sql(),
    "op1_sharding": f"""
        WITH rows AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
            FROM documents
        ), levels AS (
            SELECT doc_id, n_bytes, h, d, h >> (60 - d) AS p FROM rows, (SELECT unnest(range(0, 61))::INT AS d)
        ), sums AS (
            SELECT d, p, sum(n_bytes) AS b, count(*) AS n FROM levels GROUP BY d, p
            HAVING sum(n_bytes) <= {SHARD_LIMIT} OR min(h) = max(h)
        ), best AS (
            SELECT l.doc_id, l.h, min(s.d) AS d FROM levels l JOIN sums s ON l.d = s.d AND l.p = s.p GROUP BY l.doc_id, l.h
        )
        SELECT r.doc_id, CAST(r.n_bytes AS BIGINT) AS n_bytes, CAST(b.d AS INT) AS shard_depth, r.h >> (60 - b.d) AS shard_prefix,
               CAST(s.b AS BIGINT) AS shard_bytes, s.n AS shard_rows
        FROM rows r JOIN best b ON r.doc_id = b.doc_id AND r.h = b.h JOIN sums s ON s.d = b.d AND s.p = r.h >> (60 - b.d)
    """,
    "op5_topk_search": f"""
        WITH codes AS (
            SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INT) AS distance
            FROM codes q, codes c WHERE q.vec_id % {QUERY_EVERY} = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
        FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {TOP_K}
    """,
}
