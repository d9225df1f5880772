"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are shuffled into one stream of words, cut into blocks of equal length. Slot i of the
mix takes the point frac(i * golden ratio), maps it through the cumulative target shares to a source, and its
rank among that source's slots names the block to take. A stream may be read twice, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
#: Odd number next to 2**31 / golden ratio; slot points repeat after 2**31 slots, evenly.
STEP, PERIOD = 1327217885, 1 << 31
CELLS, SLOT_RUN = 4096, 65536
#: Sources up to which their table (a few numbers each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, repeat: int = 2) -> DataFrame:
    """One row per source: sid, source, source_size, target, and its range [lo, hi) of cumulative target share.

    Sources by code point, null last, weigh ``weights`` in turn. Of the sorted saturation levels, the largest
    remaining total over remaining weight is the common level; whoever would pass ``repeat`` times its size stops there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # over sources only
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    s = s.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeat)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("level", F.max("level").over(everything))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    running = by_name.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("source_size").over(everything) * F.lit(total_share)
    s = s.withColumn("hi", F.coalesce(F.try_divide(F.sum("target").over(running), total), F.lit(0.0)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)))
    return s.select("sid", "source", "source_size", "target", "lo", "hi")


def schedule(sources: DataFrame, words: int, n_sources: int, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, one row per slot: slot, sid, rank (the block of the source's stream, from 0).

    Ranks come from counts per run of slots and source, so no task sees all slots of a large source.
    """
    spark = sources.sparkSession
    n = -(-words // block)
    slots = spark.range(0, n, 1, max(1, min(n // 100_000, 20_000))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", (F.col("slot") % PERIOD * STEP % PERIOD + 0.5) / PERIOD).withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = sources.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    cells = F.broadcast(cells) if n_sources <= BROADCAST_SOURCES else cells
    slots = slots.join(cells, "cell").where("u >= lo AND u < hi").select("slot", "sid", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    runs = slots.groupBy("sid", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("sid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = slots.withColumn("rn", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")))
    return ranked.join(runs, ["sid", "run"]).select("slot", "sid", (F.col("base") + F.col("rn") - 1).alias("rank"))


def mix(docs: DataFrame, seed: str = "mix", block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, row: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, size, and row) to (doc_id, source, size, source_size, target, taken, and row).

    Null sources are one source, the last; null sizes are 0; repeated rows each count; an empty table gives no rows.
    A document of no words is taken 0 times, one of very many words as any other. Only the named columns are read.
    Reruns agree: the shuffle orders by md5 of seed and doc_id, ties by doc_id, size and the columns named by row, which
    tell rows apart whose doc_ids repeat or are null.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"_row{i}") for i, c in enumerate(row)])
    ties = [f"_row{i}" for i in range(len(row))]
    sources = targets(sized, weights)
    n_sources, words = sources.agg(F.count("*"), F.coalesce(F.ceil(F.sum("target")), F.lit(0))).first()
    slots = schedule(sources, int(words), n_sources, block)

    own = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    d = sized.join(own.select("sid", F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("b", F.substring("h", 1, 3))
    part = Window.partitionBy("sid", "b").orderBy("h", "doc_id", "size", *ties)
    d = d.withColumn("rn", F.row_number().over(part)).withColumn("end", F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    parts = sized.join(own.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    parts = parts.withColumn("b", F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 3))
    parts = parts.groupBy("sid", "b").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    d = d.join(parts, ["sid", "b"]).withColumn("start", F.col("base") + F.col("end") - F.col("size"))

    # the words of a document in the first and the second reading of its source's stream, cut at block borders
    pieces = d.where("size > 0").select("sid", "b", "rn", "size", F.explode(F.array(F.col("start"), F.col("start") + F.col("source_size"))).alias("at"))
    pieces = pieces.select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("rank"))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block) - F.greatest(F.col("at"), F.col("rank") * block)
    taken = pieces.withColumn("n", overlap).join(slots.select("sid", "rank"), ["sid", "rank"]).groupBy("sid", "b", "rn").agg(F.sum("n").alias("taken"))
    d = d.join(taken, ["sid", "b", "rn"], "left")
    kept = [F.col(t).alias(c) for t, c in zip(ties, row, strict=True)]
    return d.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), *kept)


def mix_documents(docs: DataFrame) -> DataFrame:
    """mix() over documents with a text, whose size is its number of words; null text has none."""
    from aeolith.llm.common import stored

    sized, _ = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1]::BIGINT AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER w, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level FROM s3
       WINDOW w AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s4),
s6 AS (SELECT *, coalesce(sum(target) OVER (ORDER BY sid) / nullif(total, 0), 0) AS hi FROM s5),
s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s6),
slots AS (SELECT slot, ((slot % {PERIOD}) * {STEP} % {PERIOD} + 0.5) / {PERIOD} AS u
          FROM (SELECT unnest(range((SELECT (ceil(sum(target))::BIGINT + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} FROM s))) AS slot)),
n AS (SELECT sid, count(*) * {BLOCK_WORDS} AS words FROM slots JOIN s ON u >= lo AND u < hi GROUP BY sid),
o AS (SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(n.words, 0) AS words,
             sum(d.size) OVER (PARTITION BY s.sid ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN n ON n.sid = s.sid)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)))::BIGINT AS taken FROM o
"""
