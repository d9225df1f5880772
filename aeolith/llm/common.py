"""What the operators share: tables, the shared folder, and hashing of words over Arrow buffers.

Words are hashed in numpy straight from Arrow's string buffers, a few megabytes at a time, so that
neither a Python object per word nor a copy of a whole partition exists.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, dtype=bool)
_SPACE[list(SPACES)] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's; in local mode, where none is set, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.aeolith.shared.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aeolith-")
        spark.conf.set("spark.aeolith.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: lineage is cut and lost executors cost nothing. Also the path. Tables that are still there when the driver ends are deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aeolith-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.pop(path, None)


@atexit.register
def _clean_up() -> None:
    for path, spark in list(_made.items()):
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows and the bytes that one Arrow batch takes to a Python worker, in this session from now on: plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sampled(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Of rows (doc_id, group, any more) the most rows of each group with the least hashes of doc_id, ties by doc_id, and their rank.

    Groups are few and may be large: their counts give a bound of the hash that about twice as many rows pass, and only
    those are ranked. That fewer pass than wanted has a chance below e**-(most / 6): the sample is then that much smaller.
    """
    h = F.xxhash64("doc_id")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(group).orderBy(h, "doc_id")
    share = F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("_n"))
    few = rows.join(F.broadcast(sizes), F.col(group) == F.col("_g")).where((h.cast("double") / 2.0**64 + 0.5 < share) | (share >= 1.0)).drop("_g", "_n")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    size = max(_CHUNK + 1, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
            down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])
        _powers[size] = up, down
    return _powers[size]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes of a string array; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(at: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes; a longer text stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


def words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased, and the first word of each text."""
    base, raw = int(at[0]), _LOWER[data[at[0] : at[-1]]]
    at = at - base
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _SPACE[raw]
    before = np.r_[False, inside[:-1]]
    edges = at[:-1][at[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    edges = at[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    turns = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            whole += hashes[j : n - k + 1 + j] * turns[j] if n >= k else whole
        whole = mixed(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield mixed(np.array([(hashes[a:b] * turns[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
