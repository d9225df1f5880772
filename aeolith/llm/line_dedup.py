"""Removal of lines that spread over many sites.

HyperLogLog sketches of sites, one per line hash, merge by aggregation on both sides of the shuffle, so a line that
every document has costs no more than one sketch per task. Where a sketch's estimate is near the threshold, exact
distinct counts decide. Only hashes and positions are shuffled, texts once, with the positions to leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import bound, stored

MIN_SITES = 10
#: Sketches of 2**12 registers: a standard error of 1.6 %. Estimates within BAND of the threshold are counted exactly.
LG_REGISTERS, BAND = 12, 0.1
#: Lines (some 60 bytes each) up to which a table of them is broadcast, so that a very common line stays where it is; beyond, joins go by shuffle, and AQE splits what is skewed.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    """128 bits of hash for a line, blanks around it left out; null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def _lines(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "site", F.split("text", "\n", -1).alias("lines"))  # the text is hashed before it is exploded, else once a line
    d = d.select("doc_id", "th", "site", F.posexplode("lines").alias("pos", "line"))
    return d.select("doc_id", "th", "site", "pos", _key(F.col("line")).alias("key")).where("key IS NOT NULL").select("doc_id", "th", "site", "pos", "key.a", "key.b")


def _small(lines: DataFrame) -> DataFrame:
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first): the lines that min_sites distinct sites or more have, by hash, and their first place (doc_id, text hash, position).

    docs has doc_id, site, text. A null site is no site.
    """
    lines = _lines(docs)
    spread = lines.groupBy("a", "b").agg(
        F.count("site").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites"), F.min(F.struct("doc_id", "th", "pos")).alias("first")
    )
    # a line on fewer rows than min_sites can't reach it; both bounds hold some six standard errors
    spread = spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - BAND) - 1))
    spread, _ = stored(spread, "spread")
    sure = F.col("sites") > min_sites * (1 + BAND) + 1
    near = _small(spread.where(~sure).select("a", "b"))
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("exact"))
    return spread.join(exact, ["a", "b"], "left").where(sure | (F.col("exact") >= min_sites)).select("a", "b", "first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs (doc_id, site, text, any more) with boilerplate lines left out of text, and n_lines, n_removed.

    keep_first leaves a line where it first stands: the smallest doc_id, then the earliest line. Blank lines are never
    boilerplate. A null text stays null with 0 lines; repeated rows are treated alike; an empty table gives no rows. A
    text of very many lines, or of one very long line, is treated as any other, in time that grows with its length.
    Columns besides these three pass through; those named like an output column are replaced.
    """
    bad, _ = stored(boilerplate(docs, min_sites), "boilerplate")
    drop = _lines(docs).join(_small(bad), ["a", "b"])
    if keep_first:
        drop = drop.where(~F.col("first").eqNullSafe(F.struct("doc_id", "th", "pos")))
    drop = drop.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "gone")
    out = docs.withColumn("_h", F.xxhash64("text"))
    out = out.join(drop, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    lines = F.split("text", "\n", -1)

    def kept(x: Column) -> Column:
        """The lines between each two places that go, and before the first and after the last."""
        before, after = F.concat(F.array(F.lit(-1)), x["gone"]), F.concat(x["gone"], F.array(F.size(x["lines"])))
        runs = F.transform(F.arrays_zip(before.alias("s"), after.alias("e")), lambda r: F.slice(x["lines"], r["s"] + 2, r["e"] - r["s"] - 1))
        return F.array_join(F.flatten(runs), "\n")

    left = bound(F.struct(lines.alias("lines"), F.col("gone").alias("gone")), kept)
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    return out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)).drop("_d", "_t", "_h", "gone")


ORACLE = rf"""
WITH l AS (SELECT doc_id, source, text, p, string_split(text, chr(10))[p] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)),
b AS (SELECT trim(line, ' ') AS t, min(row(doc_id, p)) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
j AS (SELECT l.doc_id, l.p, l.line, b.t IS NOT NULL AND b.first <> row(l.doc_id, l.p) AS gone FROM l LEFT JOIN b ON trim(l.line, ' ') = b.t)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id
"""
