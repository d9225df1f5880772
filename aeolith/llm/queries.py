"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.llm import decontaminate, hnsw, jaccard, langid, line_dedup, lm, mixing, pii, secrets, toxicity
from aeolith.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"), "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def bucket(modulo: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulo


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(bucket(4) != 2)))
    return found.select("doc_id", F.coalesce(bucket(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (bucket(7) != 2).alias("train"))
    found = lm.score(docs)
    return found.select("doc_id", F.coalesce(bucket(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.fit()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs.where(bucket(3) != 1), labels.where(bucket(3) != 1), corpus=docs)
    found = toxicity.score(docs, index)
    return found.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("source")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_jaccard_join, op3_secret_scan, op4_language_id, op5_nearest_neighbours, op6_lm_scores, op7_source_mixing, op8_decontamination, op9_personal_data, op10_toxicity)}
ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op7_source_mixing": mixing.ORACLE, "op8_decontamination": decontaminate.ORACLE}
