"""Exact Jaccard join of word shingles, and the groups it links.

Equal sets are one set. A set is ordered by rarity (counts of all shingles in hashed cells, then the hash), and two
sets that reach the threshold share a token of their prefixes. Sets that share a token are a tile. In a tile every
member meets the HUBS first members; after these pairs are verified and their components known, only members of
different components still need to meet. They do so in size bands and blocks of bounded size, where hashed bitmaps
bound the overlap from above. Whatever passes is verified by exact intersection of the sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from aeolith.llm.common import buffers, chunks, mixed, removed, shingles, signed, small_batches, stored, words
from aeolith.llm.components import components

#: Cells that count shingles (4 bytes each where broadcast), dealt in pieces for the sum.
CELLS, PIECES = 1 << 20, 64
HUBS, BLOCK = 24, 1024
#: A token that more than one in so many rows of prefixes have is hot; no more than so many tokens are, so what is known of them is broadcast.
HOT = 10_000


def required(a: Column, b: Column, num: int, den: int) -> Column:
    """Least intersection of sets of a and b shingles whose Jaccard similarity reaches num / den."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def _sets(batch: pa.Array, k: int) -> Iterator[np.ndarray]:
    at, data = buffers(batch)
    for i, j in chunks(at):
        h, first = words(at[i : j + 1], data)
        yield from shingles(h, first, k)


def cell_counts(docs: DataFrame, k: int) -> np.ndarray:
    """In how many texts shingles of each cell occur: what a task has met is summed over tasks piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pack = np.zeros(CELLS, np.int64), zstd.ZstdCompressor(level=1)
        for b in batches:
            found = list(_sets(b.column(0), k))
            if found:
                total += np.bincount((np.concatenate(found) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        data = [pack.compress(x.astype(np.uint32).tobytes()) for x in total.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(data, pa.binary())], ["piece", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        tool, total = zstd.ZstdDecompressor(), 0
        for x in pdf["data"]:
            total = total + np.frombuffer(tool.decompress(x), np.uint32).astype(np.int64)
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "data": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    rows = docs.select("text").mapInArrow(run, "piece int, data binary").groupBy("piece").applyInPandas(add, "piece int, data binary").collect()
    out = np.zeros((PIECES, CELLS // PIECES), np.uint32)
    for r in rows:
        out[r.piece] = np.frombuffer(r.data, np.uint32)
    return out.reshape(-1)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2**j bits, about as many as there are shingles."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    at = (mixed(s) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the narrowest one's width, as rows of 64-bit words."""
    width = min(len(m) for m in maps) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), axis=0) for m in maps])


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs (doc_id, text) to doc_id, n, k1 and k2 (128 bits of the set), prefix (rarest first), map."""
    counts = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        for b in batches:
            n, k1, k2, prefix, maps = [], [], [], [], []
            for s in _sets(b.column(1), k):
                size = len(s)
                n.append(size)
                with np.errstate(over="ignore"):
                    k1.append(int(signed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(size)]))[0]))
                    k2.append(int(signed(np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]))[0]))
                kept = size - -(-num * size // den) + 1 if size else 0
                order = np.lexsort((s, cells[(s % np.uint64(CELLS)).astype(np.int64)]))[:kept]
                prefix.append(signed(s[order]))
                maps.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["doc_id", "n", "k1", "k2", "prefix", "map"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, map binary")


def _plausible(pairs: DataFrame, sig: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (x, y) those whose bitmaps allow the threshold, with their sizes."""
    a = sig.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("map").alias("mx"))
    b = sig.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("map").alias("my"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y, nx, ny = (t.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(x), bool)
            for i, (ma, mb) in enumerate(zip(t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)):
                f = folded([ma, mb])
                n = int(nx[i] + ny[i])
                keep[i] = 2 * -(-n * num // (num + den)) <= n - int(np.bitwise_count(f[0] ^ f[1]).sum())
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (x, y, nx, ny)], ["x", "y", "nx", "ny"])

    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "mx", "my").mapInArrow(run, "x long, y long, nx long, ny long")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs (x, y, nx, ny) those that reach the threshold, as links (a, b). Sets are made again for the texts in question only."""
    pairs, _ = stored(pairs, "pairs")
    who = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(s) for s in _sets(b.column(1), k)], pa.list_(pa.int64()))], ["doc_id", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(who, "doc_id", "left_semi")
    sets, _ = stored(texts.mapInArrow(run, "doc_id long, s array<long>").dropDuplicates(["doc_id"]), "sets")
    a, b = sets.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), sets.select(F.col("doc_id").alias("y"), F.col("s").alias("sy"))
    common = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(a, "x").join(b, "y").where((num + den) * common >= num * (F.col("nx") + F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _units(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components within tiles (token, doc_id, n, pos, component, map, m), by size band and pair of blocks."""
    ratio = math.log(den / num)
    band = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    t = tiles.withColumn("band", band).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("parts", parts)
    # a set meets those of its own band and, as a visitor, of the next one; its block meets every block
    t = t.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = t.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        native = (pdf["band"] == pdf["at"]).to_numpy()
        if len(pdf) < 2 or not native.any():
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        n, pos, comp, doc, part = (pdf[c].to_numpy() for c in ("n", "pos", "component", "doc_id", "part"))
        maps = folded(pdf["map"].tolist())
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        xs, ys = [], []
        for i in np.flatnonzero(native).tolist():
            total = n + n[i]
            least = -(-total * num // (num + den))
            ok = (comp != comp[i]) & (1 + np.minimum(n - pos, n[i] - pos[i]) - 1 >= least) & (~native | (doc > doc[i])) & ((part != part[i]) if p != q else True)
            j = np.flatnonzero(ok)
            if len(j):
                j = j[total[j] - np.bitwise_count(maps[j] ^ maps[i]).sum(1) >= 2 * least[j]]
                xs.append(np.full(len(j), doc[i]))
                ys.append(doc[j])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    return t.groupBy("token", "at", "p", "q").applyInPandas(run, "x long, y long").distinct()


def groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id: one row for each row of docs.

    Two texts link when the Jaccard similarity of their sets of k-word shingles reaches num / den; component_id is the
    smallest doc_id reachable by links, itself included. A null text and one without words have the empty set, linked
    with nothing; a shorter text is one shingle. Texts are read whole; the set of a very long one is held in memory.
    Shingles are known by 64-bit hashes: two that share one, of which a set of ten million has one in 370,000, count as one.
    Repeated rows link like copies. A null doc_id gets the component of
    copies that have one, else null. Empty tables give no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sig, _ = stored(signatures(docs, k, num, den), "signatures")
    rep = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    rep, _ = stored(rep, "representatives")
    sets = sig.where("n > 0").join(rep.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    tokens = sets.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    sizes, _ = stored(tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    hot = F.broadcast(sizes.where(F.col("m") > max(HUBS, (sizes.agg(F.sum("m")).first()[0] or 0) // HOT)))
    cool = tokens.join(hot.select("token"), "token", "left_anti").join(sizes, "token")
    tokens = cool.select("doc_id", "n", "pos", "token", "m", F.lit(False).alias("hot")).union(tokens.join(hot, "token").select("doc_id", "n", "pos", "token", "m", F.lit(True)))
    tokens, tokens_at = stored(tokens.withColumn("h", F.xxhash64("doc_id")), "tokens")

    # every member with the hubs before it, the first HUBS by hash; of a hot token each task sends HUBS members at most, and the hubs go to the members
    order = Window.partitionBy("token").orderBy("h", "doc_id")
    hub = tokens.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= HUBS)
    hub = hub.groupBy("token", "hot").agg(F.collect_list(F.struct("h", F.col("doc_id").alias("d"), F.col("n").alias("hn"), F.col("pos").alias("hp"))).alias("hubs"))
    need = lambda h: required(F.col("n"), h["hn"], num, den)
    before = lambda h: (h["h"] < F.col("h")) | ((h["h"] == F.col("h")) & (h["d"] < F.col("doc_id")))
    fits = lambda h: before(h) & (F.least(F.col("n"), h["hn"]) >= need(h)) & (F.least(F.col("n") - F.col("pos"), h["hn"] - h["hp"]) >= need(h))
    with_hubs = tokens.where("NOT hot").join(hub.where("NOT hot").select("token", "hubs"), "token").select("doc_id", "n", "pos", "h", "hubs")
    with_hubs = with_hubs.union(tokens.where("hot").join(F.broadcast(hub.where("hot").select("token", "hubs")), "token").select("doc_id", "n", "pos", "h", "hubs"))
    met = with_hubs.select("doc_id", F.explode(F.filter("hubs", fits)).alias("x")).select(F.least("doc_id", "x.d").alias("x"), F.greatest("doc_id", "x.d").alias("y")).distinct()
    first, _ = stored(_verified(docs, _plausible(met, sets, num, den), k, num, den), "links")
    labels, labels_at = components(first)

    # the rest: large tiles that still hold several components
    large = tokens.where(F.col("m") > HUBS + 1).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = large.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    tiles = large.join(several, "token", "left_semi").join(sets.select("doc_id", "map"), "doc_id")
    more = _units(tiles.select("token", "doc_id", "n", "pos", "component", "map", "m"), num, den)
    size = sets.select("doc_id", F.col("n").alias("size"))
    more = more.join(size.select(F.col("doc_id").alias("x"), F.col("size").alias("nx")), "x").join(size.select(F.col("doc_id").alias("y"), F.col("size").alias("ny")), "y")
    second, _ = stored(_verified(docs, more.select("x", "y", "nx", "ny"), k, num, den), "links")
    if not second.isEmpty():
        star = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
        labels, _ = components(star.union(second))
    removed(spark, tokens_at)

    named = rep.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))
