"""The operators' queries over the given tables, and their DuckDB SQL where it can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offerloom.llm import bpe, embeddings, fingerprint, langid, lexical, minhash, mixing, pages, secrets, sharding, tokencount, toxicity, whitening

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


#: Its pieces and scores are read as a unigram vocabulary.
UNIGRAM = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHash(words=2))


def op4_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.Vocabulary.read(public_tokenizers.path(UNIGRAM))
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_pca_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_url_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_rmq_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cholesky_qr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nb_ngram_toxicity": op1_nb_ngram_toxicity,
    "op2_guess_cost_secrets": op2_guess_cost_secrets,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_viterbi_token_counts": op4_viterbi_token_counts,
    "op5_multiset_fingerprint": op5_multiset_fingerprint,
    "op6_min_cost_mix": op6_min_cost_mix,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pca_embedding_dedup": op8_pca_embedding_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_page_diff": op10_url_page_diff,
    "op11_rmq_ranked_search": op11_rmq_ranked_search,
    "op12_cholesky_qr_whitening": op12_cholesky_qr_whitening,
    "op13_minimax_sharding": op13_minimax_sharding,
}

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op11_rmq_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {TERMS} AS terms FROM documents),
        held AS (SELECT row_id, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
        total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS length FROM held),
        asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
        words AS (SELECT DISTINCT term FROM asked),
        tf AS (SELECT row_id, doc_id, n, term, count(*)::HUGEINT AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM held) SEMI JOIN words USING (term) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs)::DOUBLE + 2) / (2 * count(*) + 1)))::HUGEINT AS w FROM tf, total GROUP BY term),
        impacts AS (SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) AS impact FROM tf JOIN weights USING (term), total),
        scores AS (SELECT item_id, row_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
        ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_id) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 10
    """,
}
