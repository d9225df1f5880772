"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node, so that many copies neither break a graph apart nor crowd out neighbours. Nodes are dealt
into shards of about SHARD nodes by a hash of the vector. A shard's graph is a row of flat neighbour arrays, one a
level. A graph meets QUERY_BLOCK queries at a time, so that few copies of it are made; IN_STEP of these walk it
together, one hop at a time in numpy; the shards' results are merged. Work is queries times shards, by the method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, QUERY_BLOCK, IN_STEP = 16_384, 16_384, 256
#: Neighbours of a node, twice as many on level 0; beam widths in building and searching; nodes inserted at a time.
LINKS, BUILD_BEAM, SEARCH_BEAM, BATCH = 16, 64, 144, 256


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: node numbers (-1 beyond those found) and inner products, best first."""
    rows = np.arange(len(q))
    ids, sims, done = np.full((len(q), width), -1), np.full((len(q), width), -np.inf, np.float32), np.ones((len(q), width), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", q, x[entry]), False
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, entry] = True
    live = rows
    while True:
        waiting = np.where(done[live], -np.inf, sims[live])
        at = waiting.argmax(1)
        go = waiting[np.arange(len(live)), at] > -np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        next_ = links[ids[live, at]]
        new = (next_ >= 0) & ~seen[live[:, None], next_]
        r, c = np.nonzero(new)
        seen[live[r], next_[r, c]] = True
        s = np.full(next_.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("kd,kd->k", q[live[r]], x[next_[r, c]])
        every = np.concatenate([sims[live], s], 1)
        top = np.argpartition(-every, width - 1, 1)[:, :width]
        sims[live] = np.take_along_axis(every, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, next_, -1)], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), top, 1)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (rows by similarity, -1 empty) at most ``most``: first those nearer to the row's node than to any kept one, then the nearest."""
    own = x[np.maximum(ids, 0)]
    between = np.einsum("rcd,red->rce", own, own)
    kept = np.zeros(ids.shape, bool)
    near = np.full(ids.shape, -np.inf, np.float32)
    for c in range(ids.shape[1]):
        take = (ids[:, c] >= 0) & (sims[:, c] > near[:, c]) & (kept.sum(1) < most)
        kept[:, c] = take
        near = np.where(take[:, None], np.maximum(near, between[:, c]), near)
    order = np.argsort(np.where(ids < 0, 2, ~kept), 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _by_similarity(x: np.ndarray, node: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sims = np.where(ids >= 0, np.einsum("rd,rcd->rc", x[node], x[np.maximum(ids, 0)]), -np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays by level, from level 0; the nodes of a level are the first of x, as x is in random order."""
    sizes = [len(x)]
    while sizes[-1] > 2 * LINKS:
        sizes.append(sizes[-1] // LINKS)
    levels: list[np.ndarray] = []
    for n in reversed(sizes):
        most = LINKS * (2 if n == len(x) else 1)
        links = np.full((n, most), -1)
        for a in range(0, n, BATCH):
            node = np.arange(a, min(n, a + BATCH))
            peers = np.where(node[None, :] == node[:, None], -1, np.broadcast_to(node, (len(node), len(node))))
            peers = _by_similarity(x, node, peers)[0][:, :most]
            if a:
                entry = np.zeros(len(node), np.int64)
                for upper in levels:
                    if len(upper) <= a:
                        entry = beam(x[: len(upper)], upper, x[node], entry, 1)[0][:, 0]
                found, _ = beam(x[:a], links[:a], x[node], entry, BUILD_BEAM)
                peers = np.concatenate([found, peers], 1)
            ids, sims = _by_similarity(x, node, peers)
            links[node] = _spread(x, ids, sims, most)
            # the other way round; a full node keeps those that spread best
            source, slot = np.nonzero(links[node] >= 0)
            target, source = links[node][source, slot], node[source]
            if not len(target):
                continue
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
            who = target[first]
            more = np.full((len(who), rank.max(initial=0) + 1), -1)
            more[np.repeat(np.arange(len(who)), np.diff(np.r_[first, len(target)])), rank] = source
            more[(more[:, :, None] == links[who][:, None, :]).any(2)] = -1
            ids, sims = _by_similarity(x, who, np.concatenate([links[who], more], 1))
            links[who] = _spread(x, ids[:, : 2 * most], sims[:, : 2 * most], most)
        levels.append(links)
    return levels[::-1]


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the width nodes found for each query, best first."""
    entry = np.zeros(len(q), np.int64)
    for upper in levels[:0:-1]:
        entry = beam(x[: len(upper)], upper, q, entry, 1)[0][:, 0]
    return beam(x, levels[0], q, entry, width)[0]


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def index(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """nodes (vec_id, v: array<float>, distinct v) to a row a shard: dim, shard, ids, vectors, levels (sizes and flat neighbour arrays)."""
    n = nodes.count()
    shards = max(1, -(-n // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "vec_id"])
        x = np.array(pdf["v"].tolist(), np.float32)
        levels = build(x)
        flat = np.concatenate([g.reshape(-1) for g in levels]).astype(np.int32)
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "sizes": [np.array([g.shape for g in levels], np.int64).tobytes()], "links": [flat.tobytes()]})

    dealt = nodes.withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, ids binary, vectors binary, sizes binary, links binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, width: int = SEARCH_BEAM) -> DataFrame:
    """vectors (vec_id, embedding) to query_id, rank, vec_id, score: for each query row the k nearest other rows found.

    Rows with a null vec_id or an unusable vector take no part; vectors of another dimension aren't compared. Copies of
    a vector tie and go by vec_id. Fewer than k candidates give all. Repeated rows of a vec_id count once. Empty tables
    give no rows; other columns aren't read. Scores are inner products of the original vectors in double precision.
    """
    from aeolith.llm.common import small_batches, stored

    good = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    nodes, _ = stored(good.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "nodes")
    # a copy can only be a result if fewer than k + 1 copies come before it
    copies = good.join(nodes.select("v", F.col("vec_id").alias("node")), "v").select("node", "vec_id").distinct()
    copies = copies.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("rn") <= k + 1).drop("rn")
    graphs, _ = stored(index(nodes), "hnsw")

    queries = good.where(is_query).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    packed = queries.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    shards = graphs.agg(F.max("shard")).first()[0]
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards or 0)))))
    work = pairs.join(graphs, ["dim", "shard"]).repartition("dim", "shard", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.float32).reshape(-1, r.dim)
                flat, levels, at = np.frombuffer(r.links, np.int32), [], 0
                for n, m in np.frombuffer(r.sizes, np.int64).reshape(-1, 2).tolist():
                    levels.append(flat[at : at + n * m].reshape(n, m))
                    at += n * m
                who = np.array([s["vec_id"] for s in r.q], np.int64)
                q = np.array([s["v"] for s in r.q], np.float32)
                found = np.concatenate([search(x, levels, q[a : a + IN_STEP], min(width, max(len(x), 1)))[:, : k + 1] for a in range(0, len(q), IN_STEP)])
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                score = np.einsum("kd,kd->k", q[row].astype(np.float64), x[node].astype(np.float64))
                yield pd.DataFrame({"query_id": who[row], "node": ids[node], "score": score})

    small_batches(vectors.sparkSession, 1)
    found = work.mapInPandas(run, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
    found = found.join(copies, "node").where("vec_id <> query_id").dropDuplicates(["query_id", "vec_id"])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
