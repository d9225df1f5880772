"""HNSW against brute force: recall, ties of copies, rows that take no part."""

import math

import numpy as np
from pyspark.sql import functions as F

from aeolith.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def test_recall_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 3000)] + 0.7 * rng.normal(size=(3000, 24))).astype(np.float32)
    monkeypatch.setattr(hnsw.index, "__defaults__", (700,))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).selectExpr("*", "1 AS shard", "2 AS v")
    got = {}
    for r in hnsw.nearest(d, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append(r)
    s = x[::20].astype(float) @ x.astype(float).T
    hit = 0
    for q, row in zip(range(0, 3000, 20), s, strict=True):
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(math.isclose(r.score, row[r.vec_id], rel_tol=1e-12) for r in own)
        row[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.argsort(-row)[:20].tolist()))
    assert hit >= 0.9 * 20 * 150


def test_copies_tie_by_id_and_fill_the_ranks(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [0.5, 0.1 * i]) for i in range(3)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin(0, 40), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, k, k) for k in range(1, 6)] + [(40, k, k - 1) for k in range(1, 6)]


def test_unusable_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (20, [nan, 1.0]), (40, [inf, 1.0]), (60, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (5, [-1.0, 0.0]), (1, [2.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4.0), (0, 2, 5, -1.0)]
    assert hnsw.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0
