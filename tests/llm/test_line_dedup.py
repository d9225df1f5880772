"""Line dedup against exact counts."""

import random
import time
from collections import defaultdict

from aeolith.llm import line_dedup


def brute(rows, least, keep_first=True):
    sites, first = defaultdict(set), {}
    for i, s, t in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            k = line.strip(" ")
            if k:
                sites[k].add(s)
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, s, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = [len(sites[x.strip(" ")] - {None}) >= least and not (keep_first and first[x.strip(" ")] == (i, p)) if x.strip(" ") else False for p, x in enumerate(lines)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    common = [f"common line {j}" for j in range(40)]
    rows = []
    for i in range(400):
        site = rng.choice([f"s{j}" for j in range(25)] + [None])
        lines = [rng.choice(common[: rng.choice((1, 5, 40))]) if rng.random() < 0.4 else f"own {i} {j}" for j in range(rng.randint(1, 8))]
        rows.append((i, site, "\n".join(lines + ["", "  "][: rng.randint(0, 2)])))
    return rows + [(900, "s1", None), (901, "s2", ""), (902, None, "common line 0"), (903, "s3", "  common line 0 ")]


def test_against_exact_counts(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, site string, text string").selectExpr("*", "1 AS pos", "2 AS a", "3 AS n_lines", "4 AS th")
    for least, keep in ((10, True), (20, True), (23, False)):
        got = line_dedup.dedup_lines(d, least, keep).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute(rows, least, keep)


def test_many_sites_near_the_threshold(spark):
    """At thousands of sites the sketch is only an estimate; exact counts decide near the threshold."""
    rows = [(i, f"site{i}", "just below") for i in range(2999)] + [(10_000 + i, f"site{i}", "just there") for i in range(3000)] + [(20_000 + i, f"site{i}", "far over") for i in range(5000)]
    bad = line_dedup.boilerplate(spark.createDataFrame(rows, "doc_id long, site string, text string"), 3000)
    assert sorted(r["first"].doc_id for r in bad.collect()) == [10_000, 20_000]


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, site string, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, f"s{i}", "same\nown") for i in range(12)] + [(None, "s1", "same")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 13


def test_very_many_and_very_long_lines(spark):
    """50 000 lines, half of them boilerplate, and a line of a megabyte, on ten sites each: in time that grows with the lines."""
    mixed = "\n".join(x for i in range(25_000) for x in (f"shared {i}", f"own {i}"))
    rows = [(i, f"s{i}", mixed + f"\nlast {i}\n" + "y" * 1_000_000) for i in range(10)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, site string, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].n_removed == 0 and got[0].text == rows[0][2]
    assert all(got[i].n_lines == 50_002 and got[i].n_removed == 50_001 and got[i].text == f"last {i}" for i in range(1, 10))


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    rows = corpus()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, site string, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute(rows, 10, True)
