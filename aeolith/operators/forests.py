"""A random forest on coarse drivers, from one pass over the records.

As MLlib's, each tree learns from all records with Poisson weights of its own, of each node a third of the drivers may
be split, at 32 bins at most. A tree can't tell records of one cell of bins apart, so it needs only the sums of weights
and weighted targets by cell, and those of all trees are taken together. Trees then grow on cells, however many the records.
Thresholds are values or quantiles of all records, where MLlib takes points between those of a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of bins up to which a forest is grown from sums by cell.
CELLS = 1 << 17
#: Records whose weights are drawn at once, and cells of a row of sums.
BLOCK, CHUNK = 1 << 18, 512


@dataclass(frozen=True)
class Grid:
    """Thresholds of each driver, and answers in the cells between them; a value equal to a threshold is below it."""

    splits: list[np.ndarray]
    table: np.ndarray


def _splits(d: DataFrame, names: list[str], bins: int) -> tuple[list[np.ndarray], float, int]:
    """Thresholds of each driver: all values but the largest, if they are few, else quantiles; mean of the target; records."""
    fine = F.array(*[F.lit(i / 1024) for i in range(1025)])
    r = d.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), fine, F.lit(10_000)).alias(f"_{i}") for i, c in enumerate(names)], F.avg("_y").alias("mean"), F.count("*").alias("n")).first()
    found = []
    for i in range(len(names)):
        values = np.unique(r[f"_{i}"] or [0.0])
        found.append(values[:-1] if len(values) <= bins else np.unique(r[f"_{i}"][:: 1024 // bins][1:-1]))
    return found, r["mean"] or 0.0, r["n"]


def _drawn(splits: list[np.ndarray], mean: float, trees: int, seed: int):
    shape = [len(x) + 1 for x in splits]
    n = math.prod(shape)
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        weights, sums, waiting, held = np.zeros((trees, n)), np.zeros((trees, n)), [], 0

        def take() -> None:
            cell, y = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for t in range(trees):
                k = rng.poisson(1.0, len(y)).astype(float)
                weights[t] += np.bincount(cell, k, n)
                sums[t] += np.bincount(cell, k * y, n)
            waiting.clear()

        for b in batches:
            y, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            waiting.append((sum(np.searchsorted(t, v) * s for t, v, s in zip(splits, x, strides, strict=True)), y - mean))
            held += len(y)
            if held >= BLOCK:
                take()
                held = 0
        if waiting:
            take()
        for t in range(trees):
            parts = [i for i in range(0, n, CHUNK) if weights[t, i : i + CHUNK].any()]
            columns = [*(pa.array(x, pa.int32()) for x in ([t] * len(parts), parts, [part] * len(parts))), *(pa.array([x[t, i : i + CHUNK].tobytes() for i in parts], pa.binary()) for x in (weights, sums))]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "at", "part", "w", "s"])

    return run


def grower(shape: tuple[int, ...], depth: int):
    """A function from the sums of weights and of weighted targets by cell to a tree's answer in every cell, split where variance falls most."""
    at = np.indices(shape).reshape(len(shape), -1)
    tried = math.ceil(len(shape) / 3)

    def grow(w: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        answers, cells, node = np.zeros(w.size), np.arange(w.size), np.zeros(w.size, int)
        for level in range(depth + 1):
            m = int(node.max()) + 1
            sw, ss = np.bincount(node, w[cells], m), np.bincount(node, s[cells], m)
            answers[cells] = (ss / np.where(sw > 0, sw, 1))[node]
            if level == depth:
                break
            mine = np.argsort(rng.random((m, len(shape))), 1)[:, :tried]
            best, which, where = np.zeros(m), np.zeros(m, int), np.zeros(m, int)
            for i, k in enumerate(shape):
                lw, ls = (np.bincount(node * k + at[i, cells], x[cells], m * k).reshape(m, k)[:, :-1].cumsum(1) for x in (w, s))
                if k == 1:
                    continue
                rw, rs = sw[:, None] - lw, ss[:, None] - ls
                ok = (lw > 0) & (rw > 0) & (mine == i).any(1)[:, None]
                both = ls**2 / np.where(ok, lw, 1) + rs**2 / np.where(ok, rw, 1)
                gain = np.where(ok, both - (ss**2 / np.where(sw > 0, sw, 1))[:, None], 0.0)
                gain[gain <= 1e-12 * both] = 0.0
                j = gain.argmax(1)
                more = gain[np.arange(m), j] > best
                best, which, where = np.where(more, gain[np.arange(m), j], best), np.where(more, i, which), np.where(more, j, where)
            going = best[node] > 0
            if not going.any():
                break
            cells, node = cells[going], node[going]
            node = 2 * node + (at[which[node], cells] > where[node])
            node = np.unique(node, return_inverse=True)[1]
        return answers

    return grow


def _grown(shape: tuple[int, ...], depth: int, seed: int):
    grow = grower(shape, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = math.prod(shape), {}
        for b in batches:
            for t, i, w, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = found.setdefault(t, np.zeros((2, n)))
                own[0, i : i + CHUNK] += np.frombuffer(w)
                own[1, i : i + CHUNK] += np.frombuffer(s)
        for t, (w, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([grow(w, s, np.random.default_rng([seed, 1 << 20, t])).tobytes()], pa.binary())], ["answers"])

    return run


def coarse_forest(d: DataFrame, names: list[str], seed: int, trees: int = 30, depth: int = 8, bins: int = 32) -> Grid | None:
    """The forest's mean answers for the target _y in all cells; None if the drivers' bins make more than CELLS."""
    splits, mean, n = _splits(d, names, bins)
    shape = tuple(len(x) + 1 for x in splits)
    if not n:
        raise ValueError("no complete records to learn from")
    if math.prod(shape) > CELLS:
        return None
    drawn = d.select(F.col("_y").cast("double"), *[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(_drawn(splits, mean, trees, seed), "tree int, at int, part int, w binary, s binary")
    # in order, so that reruns add up alike
    grown = drawn.repartition(trees, "tree").sortWithinPartitions("tree", "at", "part").drop("part").mapInArrow(_grown(shape, depth, seed), "answers binary")
    total, found = np.zeros(math.prod(shape)), 0
    for r in grown.collect():  # a table of CELLS at most from each tree
        total += np.frombuffer(r.answers)
        found += 1
    return Grid(splits, (total / max(1, found) + mean).reshape(shape))
