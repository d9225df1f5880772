"""The Jaccard join against all pairs."""

import random

import pytest

from aeolith.llm import jaccard


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    texts = []
    for size in (6, 12, 40, 120):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(rng.choice((1, 3, 40))):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 14))):
                    w[rng.randrange(size)] = word()
                texts.append(" ".join(w))
    texts += ["", None, "one", "ONE", "a b c", "A  b\tc\n", " \n", "x y z w", texts[0], texts[0]]
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_against_all_pairs(spark, k, num, den):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n", "1 AS component", "2 AS token")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(d, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_tiles_meet_in_blocks(spark, monkeypatch):
    """With few hubs and small blocks, what the hubs leave is found by the banded units."""
    monkeypatch.setattr(jaccard, "HUBS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_empty_table_and_null_ids(spark):
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u"), (7, "a b c d e")]
    got = sorted([(r.doc_id or -1, r.component_id or -1) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()])
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_very_long_texts(spark):
    """Texts of a megabyte: one word, a near copy of 200 000 words, one that is just too far, one word repeated."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]

    def changed(n):
        out = list(w)
        for i in rng.sample(range(len(w)), n):
            out[i] = f"x{i}"
        return " ".join(out)

    rows = [(1, " ".join(w)), (2, changed(2000)), (3, changed(12_000)), (4, "y" * 1_000_000), (5, "z " * 500_000)]
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 85, 100).items()} and got[2] == 1 and got[3] == 3


def test_hot_token(spark, monkeypatch):
    """A token that many sets share is met by broadcast hubs; the result is that of the other way."""
    monkeypatch.setattr(jaccard, "HOT", 10)
    monkeypatch.setattr(jaccard, "HUBS", 3)
    rows = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85, 100)
