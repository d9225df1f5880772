"""The mix against the contract's numbers, worked out by hand."""

import math
import random

from pyspark.sql import functions as F

from aeolith.llm import mixing


def water(sizes):
    """Targets by resharing the excess until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = total / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
        free -= full


def made(seed, sources=7):
    rng = random.Random(seed)
    return [(i, rng.choice([*(f"s{j}" for j in range(sources)), None, "hot", "hot", "hot"]), rng.choice((0, 1, 5, 40, 300, 2000))) for i in range(900)]


def test_targets_and_takes(spark):
    rows = made(1)
    d = spark.createDataFrame(rows, "doc_id long, source string, size long").selectExpr("*", "'x' AS sid", "1 AS rank", "2 AS target", "3 AS b")
    got = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * mixing.BLOCK_WORDS, s


def test_source_that_is_read_twice_is_whole(spark):
    rows = [(i, "big", 5000) for i in range(20)] + [(100 + i, "small", 100) for i in range(5)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    assert all(got[100 + i].taken <= 200 for i in range(5)) and math.isclose(got[100].target, 1000)


def test_repeated_rows_zero_sizes_and_empty(spark):
    schema = "doc_id long, source string, size long"
    rows = [(1, "a", 10)] * 3 + [(None, None, None), (2, "b", 0)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.taken for r in got if r.source == "a") <= 60 and all(r.taken == 0 for r in got if r.source != "a")
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", 0)], schema)).first().taken == 0


def test_slots_are_spread_evenly(spark):
    """In every stretch of the schedule each source has about its share: that is what the sequence is for."""
    sized = spark.createDataFrame([(i, f"s{i % 3}", 10_000) for i in range(30)], "doc_id long, source string, size long")
    sources = mixing.targets(sized)
    s = mixing.schedule(sources, 450_000, 3)
    share = {r.sid: r.hi - r.lo for r in sources.collect()}
    for r in s.groupBy(F.floor(F.col("slot") / 500).alias("g"), "sid").count().where("g < 14").collect():
        assert abs(r["count"] - 500 * share[r.sid]) <= 6
    assert s.groupBy("sid").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d")).where("m <> n - 1 OR d <> n").count() == 0


def test_words(spark):
    d = spark.createDataFrame([("a b\tc\n\x0bd",), ("",), (None,), (" x",), ("  ",)], "t string")
    assert [r[0] for r in d.select(mixing.word_count(F.col("t"))).collect()] == [4, 0, 0, 1, 0]
