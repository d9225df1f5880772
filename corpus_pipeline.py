"""A training corpus from documents in five stages: language, repeated lines, near copies, benchmark passages, mix.

Each stage takes all that its predecessor kept, as written to Parquet, and all but the last return the columns of
documents. Null texts have no language and go in the first stage; empty tables pass through as empty. Rows count one by
one: doc_ids may repeat or be null, and other columns than those of documents are left out. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.llm import decontaminate, jaccard, langid, line_dedup, mixing
from aeolith.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similar documents: five words, and a Jaccard similarity of 80 / 100 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; dictionaries come from a bounded sample of those labelled."""
    dicts = langid.fit(docs)
    return langid.identify(docs, dicts, COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sources, but for the first place of each; those left without any text go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS).withColumn("site", F.col("source")))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n", "")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' columns, more, and row: a number of its own for each row, written once so that it stays the same whoever reads it."""
    return stored(docs.select(*COLUMNS, *more, F.monotonically_increasing_id().alias("row")), "rows")[0]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: that of the smallest doc_id, null last, then by text, source and language.

    Rows are told apart by a number, so neither repeated nor null doc_ids join rows of different texts. Rows without
    words are in no group and all stay.
    """
    rows = numbered(docs)
    found = jaccard.groups(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, *SIMILARITY).withColumnRenamed("doc_id", "row")
    names = rows.select("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("t"), "source", "lang", "n_chars", "row").alias("name"))
    first = found.join(names, "row").groupBy("component_id").agg(F.min("name").alias("name"))
    return rows.join(first.select(F.col("name.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    hit = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    d = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    return d.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with size, source_size, target and taken; those of which no word is taken go. Each row counts by itself."""
    rows = numbered(docs, mixing.word_count(F.col("text")).alias("size"))
    taken = mixing.mix(rows.select("doc_id", "source", "size", F.xxhash64("text").alias("t"), "row"), row=("t", "row"))
    return rows.join(taken.where("taken > 0").select("row", "source_size", "target", "taken"), "row").drop("row")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: Compression classification isn't SQL; the stages are tested one by one against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
