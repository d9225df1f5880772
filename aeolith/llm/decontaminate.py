"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every item is cut into windows of consecutive words. A window can only lie in a document that has the window's
rarest word, so that word alone (the prefix that full containment needs) is joined with the words of the documents.
Where it stands fixes the only place where the window can lie: bounds on position and length, then comparison of all
its words, follow in the same stage, with no shuffle of texts. So it is while the windows can be broadcast; beyond,
words and their places meet the anchors by shuffle, and only documents with a place that fits are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows up to which they are broadcast, each some 10 words long.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(wid, w, item_id): each distinct window of each item; an item of fewer words is one window. Null item_ids have none."""
    w = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    cut = F.when(F.size("words") >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))), lambda i: F.slice("words", i, width)))
    w = w.select("item_id", F.explode(F.coalesce(cut, F.array("words"))).alias("w"))
    return w.select(F.md5(F.array_join("w", " ")).alias("wid"), "w", "item_id").distinct()


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, th, start, len, item_id): every occurrence of a window in a document; th is a hash of the text."""
    from aeolith.llm.common import stored

    own, _ = stored(windows(items, width), "windows")
    wins = own.select("wid", "w").distinct()
    small = wins.count() <= most
    lent = F.broadcast if small else lambda x: x
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))

    # rarity: how often the documents have each word of the windows
    vocabulary = wins.select(F.explode("w").alias("word")).distinct()
    counted = d.select(F.explode("words").alias("word"))
    if small:
        df = counted.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    else:
        df = counted.groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word", "left_semi")
    placed = wins.select("wid", F.posexplode("w").alias("off", "word")).join(df, "word", "left")
    first = Window.partitionBy("wid").orderBy(F.coalesce("df", F.lit(0)), "word", "off")
    anchors = placed.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("wid", "off", F.col("word").alias("anchor"))
    anchors, _ = stored(wins.join(anchors, "wid").select("wid", "w", F.size("w").alias("len"), "anchor", "off"), "anchors")

    start = (F.col("pos") - F.col("off")).alias("start")
    at = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len"))
    if small:
        there = d.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(anchors), F.col("word") == F.col("anchor"))
        there = there.select("doc_id", "th", "words", "w", "len", "wid", start).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words")))
        found = there.where(at == F.col("w")).select("doc_id", "th", "start", "len", "wid")
    else:
        there = d.select("doc_id", "th", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word")).join(anchors.drop("w"), F.col("word") == F.col("anchor"))
        there = there.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n", "len", "wid", start).where("start >= 0 AND start + len <= n").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        texts = d.join(there.select("d", "t").distinct(), same, "left_semi").dropDuplicates(["doc_id", "th"])
        found = texts.join(there, same).where(F.md5(F.array_join(at, " ")) == F.col("wid")).select("doc_id", "th", "start", "len", "wid")
    return found.join(lent(own.select("wid", "item_id")), "wid").drop("wid")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) to doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or wordless texts have no words and no hits, wordless items and null item_ids no windows; repeated item rows
    count once; repeated documents each get their row; empty tables give no rows or no hits. Texts of any length, a
    single word of a megabyte too, are compared whole. Other columns aren't read.
    """
    per_doc = hits(docs, items, width).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.collect_set("item_id").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items"))
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM i WHERE len(w) BETWEEN 1 AND 9
        UNION SELECT DISTINCT item_id, 10, array_to_string(w[p:p + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10)),
g AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, p, g.n, item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
