"""Language-model scores against counting and expectation-maximisation by hand."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from aeolith.llm import lm, queries

SF = "/root/testdata/sf0.01"


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(1, 60))) for _ in range(120)]
    return [(i, t, i % 5 != 0) for i, t in enumerate(texts + ["", None, "NEW Words w1", texts[0], texts[1], texts[1], " \t"])]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def grams(text):
    k = tokens(text)
    one = [None, *k[:-1]]
    return list(zip([None, *one[:-1]], one, k, strict=True))


def level(count):
    return math.frexp(count)[1]


def em(rows):
    """Weight by bucket from (bucket, held-out probability, lower probability), without any rounding of ratios."""
    out, own = {}, defaultdict(list)
    for b, f, p in rows:
        own[b].append((f, p))
    for b, x in own.items():
        w = 0.5
        for _ in range(lm.ROUNDS):
            w = min(0.999, sum(w * f / (w * f + (1 - w) * p) for f, p in x) / len(x))
        out[b] = w
    return out


def brute(rows):
    one, two, three, c1, c2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, t, train in rows:
        if train:
            for a, b, c in grams(t):
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += 1
                c1[b] += 1
                c2[a, b] += 1
    n, v = sum(one.values()), len(one)
    held = lambda x, y: max(x - 1, 0) / max(y - 1, 1)
    every = [g for _, t, train in rows if train for g in grams(t)]
    mu = min(max(em([(0, held(one[c], n), 1 / (v + 1)) for _, _, c in every])[0], 1e-4), 1 - 1e-4)
    p1 = lambda c, out=0: mu * max(one[c] - out, 0) / max(n - out, 1) + (1 - mu) / (v + 1)
    w2 = em([(level(c1[b]), held(two[b, c], c1[b]), p1(c, 1)) for _, b, c in every])
    p2 = lambda b, c, out=0: w2.get(level(c1[b]), 0) * (held(two[b, c], c1[b]) if out else two[b, c] / max(c1[b], 1)) + (1 - w2.get(level(c1[b]), 0)) * p1(c, out)
    w3 = em([(level(c2[a, b]), held(three[a, b, c], c2[a, b]), p2(b, c, 1)) for a, b, c in every])
    out = []
    for i, t, train in rows:
        score = 0.0
        for a, b, c in grams(t):
            w = w3.get(level(c2[a, b]), 0)
            score += math.log10(w * three[a, b, c] / max(c2[a, b], 1) + (1 - w) * p2(b, c))
        k = tokens(t)
        out.append((i, train, len(k), sum(one[x] > 0 for x in k), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in k), score))
    return out


@pytest.mark.parametrize("part_bytes", [lm.PART_BYTES, 100])
def test_against_counting(spark, part_bytes):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean").selectExpr("*", "1 AS rows", "2 AS n")
    got = {r.doc_id: r for r in lm.score(d.repartition(3), part_bytes=part_bytes).collect()}
    assert len(got) == len(rows)
    for i, train, size, known, n, base, score in brute(rows):
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train, size, known, n)
        assert abs(r.base_score - base) < 1e-6
        assert abs(r.score - score) < 0.01 * size + 0.02  # ratios are rounded to a sixteenth of a nat when weights are learned


def test_copies_are_told_apart(spark):
    """A training text met twice is likelier a token than any met once."""
    rows = corpus()
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect() if r.train and r.n_tokens > 20}
    once = [x for i, x in got.items() if i not in (1, 124) and rows[i][1] not in (rows[0][1], rows[1][1])]
    assert min(got[1], got[124] if 124 in got else got[1]) > max(once)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_contract_numbers(spark):
    """base_score counted from the contract's words alone: log10((c + 1) / (N + 1 * (V + 1)))."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", queries.bucket(7).alias("m")).collect()
    one = Counter(w for r in d if r.m != 2 for w in tokens(r.text))
    n, v = sum(one.values()), len(one)
    got = {r.doc_id: r for r in queries.op6_lm_scores(spark, SF).collect()}
    assert n == 333537 and v == 79171 and abs(got[0].base_score + 2612.35) < 0.01 and abs(got[1].base_score + 247.55) < 0.01
    held = [0.0, 0.0]
    for r in d:
        k = tokens(r.text)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r.m == 2, len(k), sum(w in one for w in k), n)
        assert abs(g.base_score - sum(math.log10((one[w] + 1) / (n + 1 * (v + 1))) for w in k)) < 1e-6
        if r.m == 2:
            held = [held[0] + g.base_score, held[1] + g.score]
    assert held[1] > held[0]


def test_probabilities_sum_to_one(spark):
    """Over all words and a new one, after any context of a small corpus."""
    train = [("a b a c", True), ("a b b a", True), ("b a b a c", True)]
    words = ["a", "b", "c", "zz"]
    for before in ("a b", "c zz", "b"):
        n = len(before.split())
        rows = [(i, f"{before} {w}", False) for i, w in enumerate(words)] + [(9, before, False)] + [(20 + i, t, k) for i, (t, k) in enumerate(train)]
        got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
        # the text that stops here gives the chance of an end; others give that of the word and then of an end
        c = {x: v for x, v in brute_next(rows, before.split(), words).items()}
        assert abs(sum(c.values()) - 1) < 1e-6 and n and len(got) == len(rows)


def brute_next(rows, context, words):
    """Chances of each next token, by the model's own arithmetic on counts."""
    one, two, three = Counter(), Counter(), Counter()
    for _, t, train in rows:
        if train:
            for a, b, c in grams(t):
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += 1
    m = lm.Model(*map(np.array, zip(*sorted(Counter(one.values()).items()), strict=True)))
    m.pairs, m.triples = np.linspace(0, 0.9, lm.BUCKETS), np.linspace(0, 0.8, lm.BUCKETS)
    m.pairs[0] = m.triples[0] = 0
    b, a = context[-1].encode(), context[-2].encode() if len(context) > 1 else None
    out = {}
    for w in [*[x.encode() for x in words], None]:
        c = lm.Counts.__new__(lm.Counts)
        c.n1, c.n2, c.n3 = (np.array([float(x)]) for x in (one[w], two[b, w], three[a, b, w]))
        c.c1, c.c2 = np.array([float(one[b])]), np.array([float(two[a, b])])
        out[w] = 10 ** float(m.logs(c)[0])
    return out


def test_no_training_rows_long_text_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in lm.score(d).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[2].n_tokens) == (3, 0, 0, 1)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, train boolean")).count() == 0
    long = spark.createDataFrame([(1, "x" * 1_000_000, True), (2, "a b c d " * 150_000, True), (3, "a b", False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in lm.score(long).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[3].n_known) == (2, 600_001, 3)
