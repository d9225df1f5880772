"""Decontamination against a scan of every window."""

import hashlib
import random
import re

import pytest

from aeolith.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, width=10):
    out = []
    cut = []
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        if w and i is not None:
            cut += [(i, tuple(w[j : j + width])) for j in range(len(w) - width + 1)] if len(w) >= width else [(i, tuple(w))]
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, g in cut:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [100_000, 7])
def test_against_every_window(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (10, block))
    rng = random.Random(3)
    word = lambda: rng.choice(("the", "of", "Ünder", "x1", "niño", "a", "b", "c", "Q"))
    items = [(i, rng.choice((" ", ", ", "--")).join(word() for _ in range(rng.choice((1, 3, 9, 10, 11, 25))))) for i in range(12)] + [(50, ""), (51, None), (None, "the of a"), (3, "the x1 the x1")]
    docs = []
    for i in range(80):
        t = " ".join(word() for _ in range(rng.choice((0, 2, 15, 60))))
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "") + " tail"
        docs.append((i, t))
    docs += [(200, None), (201, ""), (1, docs[1][1]), (None, items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS words", "1 AS th", "2 AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' AS w")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[c] for c in cols) for r in decontaminate.decontaminate(d, b).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    e, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.decontaminate(e, i).count() == 0
    assert decontaminate.decontaminate(one, i).first().n_hit == 0
    assert decontaminate.decontaminate(e, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [100_000, 1])
def test_long_texts(spark, most):
    """A megabyte of one word, of few words, and a window at the end of a long text, in both ways to join."""
    item = " ".join(f"rare{i}" for i in range(12))
    docs = [(1, "z" * 1_000_000), (2, "a b " * 100_000 + item), (3, item[:-1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "a")], "item_id long, text string")
    found = decontaminate.hits(d, b, 10, most).groupBy("doc_id", "item_id").count().collect()
    assert sorted(tuple(r) for r in found) == [(2, 7, 3), (2, 8, 100_000), (3, 7, 2)]
