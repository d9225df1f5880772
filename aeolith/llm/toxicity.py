"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows. Terms are all their words; document frequencies come from all
documents. A word's weight is TF-IDF times how well it tells the labels apart on the examples: by TF-IDF alone the
nearest texts are those on the same matter, toxic or not. No word is left out, neither of the product nor of the norms.

The index keeps, for each term and block of examples, the largest weight. Blocks are opened from the highest bound
down, and their postings read, until no other block can better the k-th neighbour, so neighbours are exact. Votes
weighted by similarity are calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import sampled, small_batches

#: Examples a class, those with the least hash of doc_id.
SAMPLE_ROWS = 1500
#: Chi-square beyond which a word's weight grows no more, and the share of the weight that every word has.
MOST_CHI2, FLOOR = 200.0, 0.01
#: Neighbours, examples of a block, blocks opened first (each further step opens twice as many), share of examples from which a term's postings are kept as a row with a place for each example.
K, BLOCK, OPENED, DENSE = 15, 512, 2, 0.05
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Counts of words, lower-cased."""
    return Counter(_WORD.findall((text or "").lower()))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple]:
    """(doc_id, text, toxic) of at most rows examples a class; a doc_id counts once, toxic if any of its rows is. Only the picked ids, a bounded number, meet the texts."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sampled(known, "toxic", rows).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, r.toxic) for r in texts.collect())


def frequencies(docs: DataFrame, examples: list[tuple]) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the examples occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(sorted({t for x in examples for t in terms(x[1])}))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = shared.value, np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            n += len(b)
            for t in b.column(0):
                found = [i for w in set(_WORD.findall((t.as_py() or "").lower())) if (i := known.get(w)) is not None]
                total[found] += 1
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, -1]), pa.array(np.r_[total[k], n])], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    found = dict(zip(got["term"], got["n"], strict=True))
    return {t: found.get(i, 0) for t, i in shared.value.items()}, found.get(-1, 0)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    size = ends - starts
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size - starts, size), which


def _alike(examples: list[tuple]) -> list[tuple]:
    """Examples in an order that puts like ones in one block, which makes bounds closer: by label, then by the rarest word that is in several of a label, then doc_id."""
    counts = [terms(x[1]) for x in examples]
    df = Counter(t for c in counts for t in c)
    names = [min((t for t in c if df[t] > 3), key=lambda t: (df[t], t), default="") for c in counts]
    return [examples[i] for i in sorted(range(len(examples)), key=lambda i: (-examples[i][2], names[i], examples[i][0]))]


class Index:
    """The examples' vectors as an inverted index with block maxima, and the calibration of votes.

    df and documents are the frequencies of words among all documents; without them those among the examples serve.
    """

    def __init__(self, examples: list[tuple], prior: float | None = None, k: int = K, df: dict[str, int] | None = None, documents: int = 0):
        examples = _alike(examples)
        self.k, self.ids = k, np.array([x[0] for x in examples], np.int64)
        self.label = np.array([x[2] for x in examples], np.float64)
        counts = [terms(x[1]) for x in examples]
        n, pos = len(examples), float(self.label.sum())
        here, tox = Counter(), Counter()
        for c, y in zip(counts, self.label, strict=True):
            here.update(c.keys())
            if y:
                tox.update(c.keys())
        self.vocabulary = {t: i for i, t in enumerate(sorted(here))}
        d, a = (np.array([x[t] for t in self.vocabulary], np.float64) for x in (here, tox))
        every = np.array([max((df or here)[t], here[t]) for t in self.vocabulary], np.float64)
        expected = d * pos / max(n, 1)
        chi2 = (a - expected) ** 2 * n / (expected * (n - pos) * (1 - d / max(n, 1)) + 1e-9) if 0 < pos < n else np.zeros(len(d))
        chi2 = chi2 * np.where(a > expected, 1, 0.25)  # a word of clean texts tells less
        idf = np.log((1 + max(documents, n)) / (1 + every)) + 1
        self.weight = idf * (FLOOR + (1 - FLOOR) * np.sqrt(np.minimum(chi2, MOST_CHI2) / MOST_CHI2))

        vectors = [self.vector(c) for c in counts]
        term, doc = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)]), np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        order = np.lexsort((doc, term))
        term, self.docs, self.weights = term[order], doc[order], weight[order]
        # an entry is a term's postings in a block
        block = self.docs // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.entry = np.r_[first, len(term)]
        self.entry_block, self.maxima = block[first], np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.first = np.searchsorted(term[first], np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-n // BLOCK) if n else 0
        # the postings of very common terms again, as rows, and their largest weights by block
        common = np.flatnonzero(d >= max(DENSE * n, 8))
        self.row = np.full(len(self.vocabulary), -1)
        self.row[common] = np.arange(len(common))
        self.rows, mine = np.zeros((len(common), n)), self.row[term] >= 0
        self.rows[self.row[term[mine]], self.docs[mine]] = self.weights[mine]
        self.row_maxima = np.stack([self.rows[:, a : a + BLOCK].max(1) for a in range(0, n, BLOCK)], 1) if n else np.zeros((0, 0))
        # votes of the examples, each without itself, calibrated by weighted counts in bins
        self.prior = prior if prior is not None else (pos / n if n else 0.0)
        share = np.where(self.label > 0, self.prior / max(pos / max(n, 1), 1e-9), (1 - self.prior) / max(1 - pos / max(n, 1), 1e-9))
        votes = np.array([self._vote(*self.nearest(t, w, leave=i)) if len(t) else -1.0 for i, (t, w) in enumerate(vectors)])
        self.bins = np.zeros(22)
        slot = np.where(votes < 0, 21, np.clip((votes * 20).astype(int), 0, 20)) if n else np.zeros(0, int)
        good, total = np.bincount(slot, share * self.label, 22), np.bincount(slot, share, 22)
        rate = (good[:21] + 0.5 * np.linspace(0, 1, 21)) / (total[:21] + 0.5)
        self.bins[:21], self.bins[21] = np.maximum.accumulate(rate), (good[21] + self.prior) / (total[21] + 1)
        self.told = 0 < pos < n

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights (1 + log tf) * weight of unit length; words that no example has aren't counted."""
        get = self.vocabulary.get
        t, n = np.array([get(x, -1) for x in counts], np.int64), np.array(list(counts.values()), np.float64)
        t, n = t[t >= 0], n[t >= 0]
        if not len(t):
            return t, n
        w = (1 + np.log(n)) * self.weight[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, t: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, nearest first, ties to the smaller number; none without a common term."""
        row = self.row[t]
        common = row >= 0
        row, heavy, t, w = row[common], w[common], t[~common], w[~common]
        entry, which = _spread(self.first[t], self.first[t + 1])
        own, block = w[which], self.entry_block[entry]
        bound = np.bincount(block, self.maxima[entry] * own, self.blocks) + heavy @ self.row_maxima[row]
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(self.blocks, np.int16)
        rank[order] = np.arange(self.blocks)
        rank = rank[block]
        by_rank = np.argsort(rank, kind="stable")
        entry, own, cut = entry[by_rank], own[by_rank], np.searchsorted(rank[by_rank], np.arange(self.blocks + 1))
        last, rows = int((bound > 0).sum()), self.rows[row]
        sums = np.zeros(len(self.ids))
        a, step, least = 0, OPENED, 0.0
        while a < last and bound[order[a]] >= least:
            z = min(a + step, last)
            at, of = _spread(self.entry[entry[cut[a] : cut[z]]], self.entry[entry[cut[a] : cut[z]] + 1])
            sums += np.bincount(self.docs[at], self.weights[at] * own[cut[a] : cut[z]][of], len(sums))
            for k in order[a:z].tolist() if len(row) else ():
                place = slice(k * BLOCK, (k + 1) * BLOCK)
                sums[place] += heavy @ rows[:, place]
            if leave >= 0:
                sums[leave] = 0
            if self.k < len(sums):
                least = float(np.partition(sums, -self.k)[-self.k]) - 1e-12
            a, step = z, 2 * step
        hit = np.flatnonzero((sums > 0) & (sums >= least))
        best = hit[np.lexsort((hit, -sums[hit]))][: self.k]
        return best, sums[best]

    def _vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by similarity; -1 without neighbours."""
        return float((self.label[near] * cosine).sum() / cosine.sum()) if len(near) and cosine.sum() > 0 else -1.0

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Calibrated score, and the doc_ids of the nearest examples as evidence."""
        if not self.told:
            return float(self.prior), []
        t, w = self.vector(terms(text))
        near, cosine = self.nearest(t, w) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        vote = self._vote(near, cosine)
        if vote < 0:
            return float(self.bins[21]), []
        return float(np.interp(vote * 20, np.arange(21), self.bins[:21])), self.ids[near[:3]].tolist()


def score(docs: DataFrame, index: Index) -> DataFrame:
    """docs (doc_id, text) to doc_id, score, predicted, evidence (doc_ids of the nearest examples).

    Null, empty and unrelated texts have no neighbours and get the rate among such examples. Without examples of both
    labels nothing is told apart and all get the share of toxic labels. Texts are read whole, very long ones too; ties
    of similarity go to toxic examples, then by the index's order. An empty table gives no rows; only these columns
    are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for b in batches:
            got = [tool.score(t.as_py()) for t in b.column(1)]
            s = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.dtypes[0][1]}, score double, predicted int, evidence array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, corpus: DataFrame | None = None) -> Index:
    """The index from docs (doc_id, text) and labels (doc_id, toxic); the share of toxic labels is taken over all of them, document frequencies over corpus, which has a text, or docs."""
    small_batches(docs.sparkSession)
    prior = labels.where("toxic IN (0, 1)").agg(F.avg("toxic")).first()[0]
    examples = sample(docs, labels, rows)
    return Index(examples, prior or 0.0, K, *frequencies(docs if corpus is None else corpus, examples))
