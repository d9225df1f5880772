"""Each stage of the pipeline against brute force on its own input."""

import os
import random

import pytest

import corpus_pipeline
from aeolith.llm import jaccard, langid
from aeolith.llm.common import stored
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard import brute as similar
from tests.llm.test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs, _ = stored(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert after and docs.count() == len(after) and set(after) <= set(before)
        if name != "source_mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language_id":
            dicts = langid.fit(spark.createDataFrame(list(before.values())))
            tool = langid.Classifier(dicts)
            assert set(after) == {i for i, r in before.items() if not tool.predict(r.text)[2]} and len(after) > 0.95 * len(before)
        elif name == "line_dedup":
            want = {i: t for i, t, _, gone in lines([(r.doc_id, r.source, r.text) for r in before.values()], 10) if not (gone and not t.strip(" \n"))}
            assert {i: r.text for i, r in after.items()} == want
        elif name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in similar([(r.doc_id, r.text) for r in before.values()], 5, 80, 100).items() if c == i}
        elif name == "decontamination":
            assert set(after) == {w[0] for w in windows([(r.doc_id, r.text) for r in before.values()], items) if not w[5]}
        else:
            assert all(0 < r.taken <= 2 * r.size for r in after.values()) and abs(sum(r.taken for r in after.values()) / sum(len((r.text or "").split()) for r in before.values()) - 1.5) < 0.1


def test_repeated_ids_null_ids_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, "a b c d e f", "en", "s", 11, 0)] * 2 + [(None, "q r s", "en", None, 5, 0), (2, None, None, None, None, None), (3, "", "en", "s", 0, 1)]
    d = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, d, SF).collect()
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_copies(spark, d, SF).collect()) == [0, 1, 2, 3]
    assert all(stage(spark, d.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert jaccard.groups(d).count() == 5


def test_rows_of_one_doc_id_are_told_apart(spark):
    """Repeated and null doc_ids with different texts: brute force over rows, in any order of them."""
    rng = random.Random(3)
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=40))
    near = lambda t: t + " end"
    a, b, c, d = (text(i) for i in range(4))
    rows = [(5, b), (5, a), (7, a), (7, near(b)), (None, c), (None, d), (None, near(c)), (9, d), (9, ""), (9, None), (None, None), (5, a)]
    want = sorted([(5, b), (5, a), (0, c), (9, d), (9, ""), (9, ""), (0, "")])
    for _ in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
        # of c and its near copy, both without a doc_id, the one with the smaller text hash stays
        assert [(i, c if t == near(c) else t) for i, t in got] == want or sorted((i, c if t == near(c) else t) for i, t in got) == want


def test_mix_counts_rows_of_one_doc_id_apart(spark):
    rng = random.Random(4)
    rows = [(None if i % 2 else i % 7, " ".join(["w"] * 100), "en", rng.choice("abc"), 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    targets = {r.source: r.target for r in got}
    for source, target in targets.items():
        taken = [r.taken for r in got if r.source == source]
        assert abs(sum(taken) - target) <= 4 * 64 and all(0 < t <= 200 for t in taken)
    assert abs(sum(r.taken for r in got) - 60_000) <= 600


def test_very_long_texts_pass_through(spark):
    """A megabyte of words, of one word, and of lines, through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["the cat and the dog " * 60_000, "k" * 1_000_000, "a line of it\n" * 80_000, "the house and the garden of the old man"]
    d = spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES:
        if name != "language_id":
            assert {r.doc_id for r in stage(spark, d, SF).select("doc_id").collect()} <= {0, 1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, SF).select("doc_id").collect()} == {0, 1, 2, 3}
