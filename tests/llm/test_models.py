"""Language identification and toxicity: held-out accuracy, exact neighbours, odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolith.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@tables
def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and np.mean([r.rejected for r in held]) < 0.03


def test_language_of_odd_rows(spark):
    dicts = {"aa": b"alpha beta gamma delta " * 20, "bb": b"uno dos tres cuatro " * 20}
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "gamma alpha delta beta alpha gamma"), (5, "tres cuatro dos uno dos"), (5, "tres cuatro dos uno dos"), (None, "uno dos tres cuatro uno")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS lang"), dicts).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "bb"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb"), (5, "bb")]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), dicts).count() == 0
    assert langid.fit(spark.createDataFrame([(1, None, "x"), (2, "t", None)], "doc_id long, text string, lang string")) == {}


@tables
def test_toxicity_of_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, SF).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.8
    assert np.mean([s >= 0.7 for s in bad]) < 0.05


@tables
def test_neighbours_are_exact():
    """Block bounds leave out no neighbour that all dot products would give."""
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    index = toxicity.Index([(r["doc_id"], docs[r["doc_id"]], r["toxic"]) for r in labels])
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for i, d in enumerate(index.ids):
        t, w = index.vector(toxicity.terms(docs[int(d)]))
        dense[i, t] = w
    tested = 0
    for text in list(docs.values())[:300]:
        t, w = index.vector(toxicity.terms(text))
        if len(t):
            tested += 1
            near, cosine = index.nearest(t, w)
            every = dense[:, t] @ w
            want = [i for i in np.lexsort((np.arange(len(every)), -np.round(every, 12))) if every[i] > 0][: index.k]
            assert np.allclose(sorted(cosine), sorted(every[want])) and len(near) == len(want)
    assert tested > 10


def test_toxicity_of_odd_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words here") for i in range(60)] + [(100, None), (101, ""), (None, "vile")], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (100, None)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.selectExpr("*", "1 AS score"), index).collect()}
    assert len(got) == 63 and got[1].score > 0.7 > 0.3 > got[2].score and got[None].score > 0.7 and got[100].score == got[101].score
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where(F.col("predicted") == 1).count() == 0
    assert toxicity.score(docs.limit(0), index).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 63


def test_language_against_encoding_by_hand(spark):
    """Predictions of short, middling and very long texts are those of one rule: least frame of the text twice over."""
    import zstandard as zstd

    dicts = {"aa": b"alpha beta gamma delta epsilon " * 40, "bb": b"uno dos tres cuatro cinco seis " * 40, "cc": b"alpha dos gamma cuatro " * 40}
    texts = ["alpha", "dos tres", "alpha dos beta", "gamma cuatro " * 30, "beta " * 300_000, "uno dos alpha " * 1000, "zzz"]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dicts).collect()}
    for i, t in enumerate(texts):
        data = (b" " + " ".join(t.split()).encode() + (b" " if t[-1] == " " else b"")) * 2
        sizes = sorted((len(zstd.ZstdCompressor(level=langid.LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False).compress(data)), lang) for lang, d in dicts.items())
        assert got[i].lang_pred == sizes[0][1] and got[i].rejected == (sizes[1][0] - sizes[0][0] < max(1, 0.001 * sizes[0][0])), t


def test_dictionaries_are_whole_texts_of_the_sample(spark):
    rows = [(i, f"word{i} " * (5000 if i % 10 == 0 else 20), "en") for i in range(1000)] + [(5000 + i, "mot " * 40_000, "fr") for i in range(3)]
    dicts = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert set(dicts) == {"en", "fr"} and all(len(d) <= langid.DICT_BYTES for d in dicts.values())
    first = dicts["en"].split(b"\n")
    assert len(first) >= 80 and all(t.split() == [t.split()[0]] * 20 for t in first if len(t) < 2000 and len(t.split()) == 20)
    assert len(dicts["fr"]) == langid.DICT_BYTES  # there are only long texts: one, cut at the dictionary's end


def test_toxicity_by_brute_force_and_long_texts():
    """Scores from all cosines by hand, and of a text of a megabyte."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    examples = [(i, " ".join(rng.choice(words, 30)) + (" vile" * (1 + i % 3) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    df = {w: 50 + 10 * k for k, w in enumerate(words)} | {"vile": 100}
    index = toxicity.Index(examples, 0.2, 5, df, 5000)
    vectors = {x[0]: dict(zip(*[a.tolist() for a in index.vector(toxicity.terms(x[1]))], strict=True)) for x in examples}
    label = {x[0]: x[2] for x in examples}
    for text in ["vile words wba wca", " ".join(words[:50]), "nothing known here", examples[4][1], "vile " * 200_000 + " ".join(words)]:
        q = dict(zip(*[a.tolist() for a in index.vector(toxicity.terms(text))], strict=True))
        cosine = sorted(((sum(x * v.get(t, 0.0) for t, x in q.items()), i) for i, v in vectors.items()), reverse=True)[:5]
        score, evidence = index.score(text)
        if not q:
            assert evidence == [] and score == index.bins[21]
            continue
        assert abs(cosine[0][0] - sum(x * vectors[evidence[0]].get(t, 0.0) for t, x in q.items())) < 1e-9
        vote = sum(c for c, i in cosine if label[i]) / sum(c for c, _ in cosine)
        assert abs(score - np.interp(vote * 20, np.arange(21), index.bins[:21])) < 1e-6
    assert index.score("vile vile")[0] > index.score(words[0])[0]
