"""Language-model scores by deleted interpolation of trigrams, bigrams, unigrams and a uniform share.

Texts become blocks of tokens once, each word known by a 64-bit hash. A block sends each n-gram it has (once, with how
often its training texts have it) to the part that owns the n-gram's range of hashes; parts add up, and send each block
the counts back in the order of its n-grams. So every count is exact and over all training texts, nothing is
broadcast but the mixture weights, and no n-gram, however common, reaches a part more than once a block.

A context of frequency c predicts with weight w[bucket of c], which expectation-maximisation learns from the training
occurrences, each held out of its own counts. A context met once holds nothing when that occurrence is left out, so its
weight is 0, and no text is predicted from its own memory alone. Weights come from histograms of ratios of
probabilities, of fixed size, rounded to a sixteenth of a nat: one for bigrams, then one for trigrams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.llm.common import SPACES, buffers, chunks, mixed, removed, small_batches, stored, words

#: Bytes of text of a block, a longer text being one of its own; of text hashed at once, which take some forty times as many; of text whose n-grams a part owns; and most parts.
BLOCK_BYTES, CHUNK, PART_BYTES, MAX_PARTS = 4 << 20, 1 << 19, 8 << 20, 100_000
#: Bits of an n-gram's hash beyond the logarithm of the bytes of all texts (64 at most): fewer than one n-gram in 2**SPARE shares its hash with another.
SPARE = 24
#: Contexts are put in buckets by the binary logarithm of their frequency. Ratios of probabilities have BINS bins, STEPS a nat from LEAST up; bin 0 for none.
BUCKETS, BINS, STEPS, LEAST = 48, 512, 16, -6.0
ROUNDS = 200
END = mixed(np.array([0xE4D], np.uint64))[0]
SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LOW = np.uint64(3)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, after which a task gives the memory it doesn't use back: workers stay for the tasks to come, beside others."""

    def run(rows: Iterator) -> Iterator:
        yield from f(rows)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return run


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0, byte planes apart, compressed; the first byte is the number of planes."""
    x = np.ascontiguousarray(x, np.uint64)
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    flat = np.frombuffer(zstd.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :planes] = flat.T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def hashed(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words() of texts, of which long ones are hashed in pieces cut at blanks."""
    edges, owner = [int(at[0])], []
    for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while z - a > CHUNK:
            blank = np.flatnonzero(np.isin(data[a + CHUNK // 2 : min(z, a + CHUNK)], list(SPACES)))
            a = a + CHUNK // 2 + int(blank[-1]) + 1 if len(blank) else z
            if a < z:
                edges.append(a)
                owner.append(i)
        edges.append(z)
        owner.append(i)
    edges = np.array(edges)
    h, n = [], []
    for i, j in chunks(edges, CHUNK):
        one, first = words(edges[i : j + 1], data)
        h.append(one)
        n.append(np.diff(first))
    n = np.bincount(np.array(owner, np.int64), np.concatenate(n) if n else None, len(at) - 1).astype(np.int64)
    return np.concatenate(h) if h else np.zeros(0, np.uint64), np.r_[0, np.cumsum(n)]


def tokens(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Blocks (block, rows, train, lengths, words, at) of docs (keys, train, text): keys and train of each text, its number of tokens, the block's words, sorted, and the word of each token. Each text closes with an end."""
    names = [*keys, "train"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            at, data = buffers(b.column(len(names)))
            for i, j in chunks(at, BLOCK_BYTES):
                h, first = hashed(at[i : j + 1], data)
                all_ = np.insert(h, first[1:], END)
                u, back = np.unique(all_, return_inverse=True)
                rows = pa.StructArray.from_arrays([b.column(c).slice(i, j - i) for c in range(len(names))], names)
                train = np.packbits(b.column(len(keys)).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), rows), pa.array([train], pa.binary()), pa.array([pack(np.diff(first) + 1)], pa.binary()),
                        pa.array([pack_sorted(u)], pa.binary()), pa.array([pack(back)], pa.binary()),
                    ],
                    ["block", "rows", "train", "lengths", "words", "at"],
                )
                block += 1

    types = dict(docs.dtypes)
    row = ", ".join(f"`{c}`: {types[c]}" for c in names)
    return docs.select(*names, "text").mapInArrow(trimmed(run), f"block long, rows array<struct<{row}>>, train binary, lengths binary, words binary, at binary")


def of_training(row: dict, lengths: np.ndarray) -> np.ndarray:
    """Whether each token is of a training text."""
    return np.repeat(np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(lengths)].astype(bool), lengths)


class Block:
    """The n-grams of a block: distinct ones, sorted, which of them each token ends, by order, and how often training texts have each."""

    def __init__(self, row: dict, bits: int):
        self.bits = bits
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        h = unpack_sorted(row["words"])[unpack(row["at"]).astype(np.int64)]
        self.first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        one = np.r_[END, h[:-1]]
        one[self.first] = END
        two = np.r_[END, one[:-1]]
        two[self.first] = END
        with np.errstate(over="ignore"):
            pair = mixed(mixed(one + SALT[0]) + h)
            triple = mixed(mixed(mixed(two + SALT[1]) + one) + h)
        self.size = len(h)
        del one, two
        every = np.concatenate([x >> np.uint64(64 - bits) & ~_LOW | np.uint64(k) for k, x in ((1, h), (2, pair), (3, triple))])
        del h, pair, triple
        self.grams, self.which = np.unique(every, return_inverse=True)
        self.own = np.bincount(self.which, np.tile(of_training(row, self.lengths), 3), len(self.grams)).astype(np.int64)

    def cuts(self, parts: int) -> np.ndarray:
        """Where each part's n-grams begin."""
        edges = np.array([(p << self.bits) // parts for p in range(parts)], np.uint64)
        return np.r_[np.searchsorted(self.grams, edges), len(self.grams)]

    def counts(self, parts: int, found: list[dict]) -> list[np.ndarray]:
        """Training counts of the unigram, bigram and trigram that each token ends."""
        n, cut = np.zeros(len(self.grams), np.uint64), self.cuts(parts)
        for x in found:
            n[cut[x["part"]] : cut[x["part"] + 1]] = unpack(x["n"])
        n = n[self.which]
        return [n[k * self.size : (k + 1) * self.size] for k in range(3)]


_ROW = ("block", "train", "lengths", "words", "at")


def dealt(blocks: DataFrame, parts: int, bits: int) -> DataFrame:
    """(part, block, grams, n): the n-grams of each block that a part owns, and their training counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, bits)
                cut = block.cuts(parts)
                which = np.flatnonzero(np.diff(cut)).tolist()
                grams = [pack_sorted(block.grams[cut[p] : cut[p + 1]]) for p in which]
                n = [pack(block.own[cut[p] : cut[p + 1]]) for p in which]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([row["block"]] * len(which), pa.int64()), pa.array(grams, pa.binary()), pa.array(n, pa.binary())], ["part", "block", "grams", "n"])

    return blocks.select(*_ROW).mapInArrow(trimmed(run), "part int, block long, grams binary, n binary")


def added(parts: DataFrame) -> DataFrame:
    """(block, part, n): the counts over all blocks, in the order of each block's n-grams; rows without a block have, for the words of a part, counts and how many words have each."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        got = [unpack_sorted(r["grams"]) for r in rows]
        ends = np.cumsum([len(x) for x in got])
        grams, n = np.concatenate(got), np.concatenate([unpack(r["n"]) for r in rows]).astype(np.int64)
        del got
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        total = np.add.reduceat(n[order], first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(total, np.diff(np.r_[first, len(order)]))
        is_word = (grams[first] & _LOW) == 1
        value, times = np.unique(total[is_word & (total > 0)], return_counts=True)
        part = rows[0]["part"]
        out = [(r["block"], part, pack(x)) for r, x in zip(rows, np.split(back, ends[:-1]), strict=True)]
        out.append((None, part, pack(np.r_[value, times])))
        block, part, n = zip(*out, strict=True)
        return pa.table([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.binary())], ["block", "part", "n"])

    return parts.groupBy("part").applyInArrow(run, "block long, part int, n binary")


def spectrum(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts that occur among the words of the training texts, and how many words have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unpack(x.as_py()).astype(np.int64).reshape(2, -1) for x in b.column(0)]
            n, m = np.concatenate(got, 1) if got else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(m)], ["n", "m"])

    got = counts.where("block IS NULL").select("n").mapInArrow(run, "n long, m long").groupBy("n").agg(F.sum("m").alias("m")).orderBy("n").toArrow()
    return got["n"].to_numpy(), got["m"].to_numpy()


def counted(blocks: DataFrame, counts: DataFrame, parts: int, bits: int) -> DataFrame:
    """(rows, train, lengths, n1, n2, n3): the training counts of the n-grams that each token of a block ends."""
    types = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate((*_ROW, "found"))}
                n = Block(row, bits).counts(parts, row["found"])
                yield pa.RecordBatch.from_arrays([b.column(len(_ROW) + 1).slice(k, 1), b.column(1).slice(k, 1), b.column(2).slice(k, 1), *[pa.array([pack(x)], pa.binary()) for x in n]], ["rows", "train", "lengths", "n1", "n2", "n3"])

    found = counts.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "n")).alias("found"))
    return blocks.join(found, "block").select(*_ROW, "found", "rows").mapInArrow(trimmed(run), f"rows {types['rows']}, train binary, lengths binary, n1 binary, n2 binary, n3 binary")


def bucket(count: np.ndarray) -> np.ndarray:
    return np.clip(np.frexp(count.astype(np.float64))[1], 0, BUCKETS - 1)


class Counts:
    """What a row of counted() has: counts as doubles, with those of the contexts, and the first token of each text."""

    def __init__(self, row: dict):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.n1, self.n2, self.n3 = (unpack(row[k]).astype(np.float64) for k in ("n1", "n2", "n3"))
        ends = self.n1[self.first + self.lengths - 1]  # a text follows an end, and two ends
        self.c1, self.c2 = np.r_[0.0, self.n1[:-1]], np.r_[0.0, self.n2[:-1]]
        self.c1[self.first] = self.c2[self.first] = ends
        self.train = of_training(row, self.lengths)


def em(bucket_of: np.ndarray, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each bucket's weight of a distribution that is ratio times as likely as the one it is mixed with, for n occurrences each."""
    total = np.bincount(bucket_of, n, BUCKETS)
    w = np.full(BUCKETS, 0.5)
    for _ in range(ROUNDS):
        x = w[bucket_of] * ratio
        w = np.clip(np.bincount(bucket_of, n * (x / (x + 1 - w[bucket_of])), BUCKETS) / np.maximum(total, 1), 1e-9, 0.999)
    return np.where((total > 0) & (w > 1e-8), w, 0.0)


class Model:
    """Mixture weights: mu of the unigram against the uniform share, by bucket those of bigrams and of trigrams."""

    def __init__(self, value: np.ndarray, times: np.ndarray):
        """From the counts that occur among words and how many words have each."""
        n = (value * times).astype(np.float64)
        self.tokens, self.types = int(n.sum()), int(times.sum())
        self.uniform = 1.0 / (self.types + 1)
        ratio = np.maximum(value - 1, 0) / max(self.tokens - 1, 1) / self.uniform
        self.mu = min(max(float(em(np.zeros(len(n), np.int64), ratio, n)[0]), 1e-4), 1 - 1e-4) if self.tokens else 0.0
        self.pairs = self.triples = np.zeros(BUCKETS)

    def unigram(self, n1: np.ndarray, out: int = 0) -> np.ndarray:
        """Probability of words by their count, out occurrences held out."""
        return self.mu * (np.maximum(n1 - out, 0) / max(self.tokens - out, 1)) + (1 - self.mu) * self.uniform

    def histogram(self, c: Counts, triples: bool) -> np.ndarray:
        """Training tokens, each held out of all counts, by bucket of its context and by ratio of the bigram's probability over the unigram's, or of the trigram's over the mixture of both."""
        k = c.train
        p = self.unigram(c.n1[k], 1)
        held = lambda n, context: np.maximum(n[k] - 1, 0) / np.maximum(context[k] - 1, 1)
        f, context = held(c.n2, c.c1), c.c1[k]
        if triples:
            w = self.pairs[bucket(context)]
            p = w * f + (1 - w) * p
            f, context = held(c.n3, c.c2), c.c2[k]
        r = f / p
        logs = np.log(r, where=r > 0, out=np.zeros_like(r))
        at = np.where(r > 0, np.clip(np.rint((logs - LEAST) * STEPS) + 1, 1, BINS - 1), 0).astype(np.int64)
        return np.bincount(bucket(context) * BINS + at, minlength=BUCKETS * BINS)

    def learn(self, histogram: np.ndarray, triples: bool) -> None:
        ratio = np.exp((np.arange(BINS) - 1) / STEPS + LEAST)
        ratio[0] = 0
        at = np.flatnonzero(histogram)
        weights = em(at // BINS, ratio[at % BINS], histogram[at].astype(np.float64))
        if triples:
            self.triples = weights
        else:
            self.pairs = weights

    def logs(self, c: Counts) -> np.ndarray:
        """log10 of each token's probability."""
        p = self.unigram(c.n1)
        for n, context, weights in ((c.n2, c.c1, self.pairs), (c.n3, c.c2, self.triples)):
            w = weights[bucket(context)]
            p = w * (n / np.maximum(context, 1)) + (1 - w) * p
        return np.log10(p)


def histogram(counts: DataFrame, model: Model, triples: bool) -> np.ndarray:
    """Model.histogram of all training tokens; a task sends the sum of its own."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * BINS, np.int64)
        for b in batches:
            for row in b.to_pylist():
                total += shared.value.histogram(Counts(row), triples)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = counts.select("train", "lengths", "n1", "n2", "n3").mapInArrow(trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS * BINS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def score(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), part_bytes: int = PART_BYTES) -> DataFrame:
    """docs (keys, text, train) to keys, train, n_tokens, n_known, train_tokens, base_score, score, from whole texts.

    A null text is empty: one end. train null counts as false. Repeated rows are scored, and counted, each. Without
    training rows all words are unknown and every token costs the uniform share. An empty table gives no rows. A very
    long text is a block of its own and takes some hundred times its bytes while its n-grams are sorted. Columns besides
    keys, text and train aren't read.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*keys, "text", F.coalesce("train", F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)), MAX_PARTS)
    bits = min(64, SPARE + max(int(size), 1).bit_length())
    blocks, blocks_at = stored(tokens(docs, keys), "tokens")
    small_batches(spark, 4)
    counts, counts_at = stored(added(dealt(blocks, parts, bits)), "counts")
    model = Model(*spectrum(counts))
    of_tokens, of_tokens_at = stored(counted(blocks, counts, parts, bits), "counted")
    for triples in (False, True):
        model.learn(histogram(of_tokens, model, triples), triples)
    shared = spark.sparkContext.broadcast(model)
    names = [*keys, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cost = np.log10(m.tokens + m.types + 1)
        for b in batches:
            for k in range(len(b)):
                c = Counts({x: b.column(x)[k].as_py() for x in ("train", "lengths", "n1", "n2", "n3")})
                sums = [np.add.reduceat(x, c.first) for x in ((c.n1 > 0).astype(np.int64), np.log10(c.n1 + 1) - cost, m.logs(c))]
                kept = b.column(0).slice(k, 1).flatten().flatten()
                yield pa.RecordBatch.from_arrays([*kept, pa.array(c.lengths), pa.array(sums[0]), pa.array(np.full(len(c.lengths), m.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out, _ = stored(of_tokens.select("rows", "train", "lengths", "n1", "n2", "n3").mapInArrow(trimmed(run), schema), "scored")
    removed(spark, blocks_at, counts_at, of_tokens_at)
    return out
