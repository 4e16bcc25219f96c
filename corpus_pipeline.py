"""The corpus pipeline: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as Parquet to the shared folder
and hands it, read again, to the next. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, langid, minhash, mixing, secrets
from offerloom.llm.queries import TOKENIZER
from offerloom.session import checked_broadcast, cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, or no letter); ``lang`` becomes the predicted one."""
    model = spark.sparkContext.broadcast(langid.train(docs))
    rows = langid.with_language(docs.select(COLUMNS), model)
    return rows.where(F.col("lang") != langid.NO_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of every near-duplicate group: five words, similarity 0.8 or more.

    Of rows that repeat a kept doc_id one stays: the smallest by text, nulls last, then by the other columns. It has words
    if a row with words was kept. Rows without a doc_id all stay."""
    found = minhash.near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("_key"))
    marks = found.agg(F.count("*").alias("_n"), F.max("kept").alias("_kept"), F.max(F.col("kept") & (F.col("n_shingles") > 0)).alias("_words"))
    # Rows of ids that go or repeat are the exception; the texts of all others need no shuffle where those ids are few.
    marks = cut_lineage(marks.where("not _kept or _n > 1"), "marks")
    same = docs.select(COLUMNS).withColumn("_key", F.col("doc_id").cast("bigint"))
    single = same.join(checked_broadcast(marks.select("_key")), "_key", "left_anti")
    repeated = same.join(checked_broadcast(marks.where("_kept").select("_key", "_words")), "_key")
    order = ["text", *(c for c in COLUMNS if c != "text")]
    row = F.struct(((mixing.word_count() > 0) != F.col("_words")).alias("_other"), *(e for c in order for e in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))))
    one = repeated.groupBy("_key").agg(F.min(row).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in COLUMNS))
    return single.select(COLUMNS).unionByName(one)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; ``n_chars`` follows the text. All documents stay."""
    out = secrets.redact(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mixture takes it; documents without words, and rows without a doc_id, stay once."""
    mixed = mixing.mix(docs).where("size > 0").groupBy("doc_id").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_times"))
    # Both sides grow with the corpus, so the join is a shuffle at every size.
    rows = docs.select(COLUMNS).join(mixed.hint("merge"), "doc_id", "left")
    times = F.when(mixing.word_count() == 0, 1).otherwise(F.coalesce("_times", F.lit(1)))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per document; a document that the mixture repeats has as many rows."""
    return bpe.token_digests(docs, bpe.read_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("no_secrets", no_secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, guess costs and merges have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
