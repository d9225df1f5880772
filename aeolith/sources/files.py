"""Reading and writing series: text formats by declaration, parquet, several files folded into one, yearly exports."""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextFormat:
    """A delimited text layout: rows before the data, names, stamp columns joined by a blank, missing-value marks."""

    name: str
    stamps: tuple[str, ...]
    stamp_format: str
    convention: str = "END"
    seconds: float = 1800.0
    delimiter: str = ","
    skip: int = 0
    header: int = 1
    missing: tuple[str, ...] = ("-9999", "-6999", "-999", "NAN", "NaN", "nan", "")


#: Layouts by name.
FORMATS = {
    f.name: f
    for f in (
        TextFormat("csv_30min_end", ("TIMESTAMP_END",), "yyyyMMddHHmm"),
        TextFormat("csv_60min_end", ("TIMESTAMP_END",), "yyyyMMddHHmm", seconds=3600.0),
        TextFormat("fullset_hh", ("TIMESTAMP_END",), "yyyyMMddHHmm"),
        TextFormat("fullset_hr", ("TIMESTAMP_END",), "yyyyMMddHHmm", seconds=3600.0),
        TextFormat("full_output_30min", ("date", "time"), "yyyy-MM-dd HH:mm", skip=1, header=2),
        TextFormat("logger_1min", ("TIMESTAMP",), "yyyy-MM-dd HH:mm:ss", seconds=60.0, skip=1, header=3),
        TextFormat("generic_30min_middle", ("TIMESTAMP_MIDDLE",), "yyyy-MM-dd HH:mm:ss", "MIDDLE"),
        TextFormat("generic_20hz", ("TIMESTAMP",), "yyyy-MM-dd HH:mm:ss.SSS", "MIDDLE", 0.05),
    )
}


def unique_names(names: list[str]) -> list[str]:
    """Names with .1, .2 … on repeats, and unknown-N for empty ones."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n.strip() or f"unknown-{i}"
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(n if k == 0 else f"{n}.{k}")
    return out


def number(c: Column, missing: tuple[str, ...]) -> Column:
    """Text to double; marks of missing values, what can't be read, and NaN are null."""
    x = F.trim(c)
    d = x.try_cast("double")
    marks = [float(m) for m in missing if m.lstrip("-").isdigit()]
    bad = F.isnan(d) | (d.isin(marks) if marks else F.lit(False))
    return F.when(~x.isin(*missing) & ~F.coalesce(bad, F.lit(False)), d)


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the cluster's own setting; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = sc.getConf().get("spark.checkpoint.dir", "")
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="aeolith-"))


def _headers(text: DataFrame, rows: int) -> list[tuple[list[str], list[str]]]:
    """(files, header rows) of files with the same header. Each file's first rows are found where they are; only they come to the driver."""
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id")).where("b = 0")
    first = lines.groupBy("path").agg(F.min("id").alias("first"))
    head = lines.join(F.broadcast(first), "path").where(F.col("id") < F.col("first") + rows).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("h"))
    alike: dict[tuple[str, ...], list[str]] = {}
    for r in head.orderBy("path").collect():
        alike.setdefault(tuple(x.value for x in r.h), []).append(r.path)
    return [(paths, list(h)) for h, paths in alike.items()]


def read_text(spark: SparkSession, paths: str | list[str], layout: TextFormat | str, rows: int | None = None) -> DataFrame:
    """(ts, columns…) as the layout says; all columns but stamps are numbers.

    Each file is read by its own header, so columns may stand in another order or be missing in some. Only header rows
    come to the driver, and only the first block of a file is searched for rows like them.
    """
    f = FORMATS[layout] if isinstance(layout, str) else layout
    parts = []
    for files, head in _headers(spark.read.text(paths), f.skip + f.header):
        names = unique_names(head[f.skip].split(f.delimiter))
        text = spark.read.text(files).where(~((F.col("_metadata.file_block_start") == 0) & F.col("value").isin(head)) & (F.trim("value") != ""))
        row = F.from_csv("value", ", ".join(f"`c{i}` STRING" for i in range(len(names))), {"sep": f.delimiter})
        d = text.select(row.alias("p")).select(*[F.col(f"p.c{i}").alias(f"_{i}") for i in range(len(names))])
        at = {n: f"_{i}" for i, n in enumerate(names)}
        stamp = F.try_to_timestamp(F.concat_ws(" ", *[F.trim(at[s]) for s in f.stamps]), F.lit(f.stamp_format)).cast("timestamp_ntz")
        parts.append(d.select(stamp.alias("ts"), *[number(F.col(at[n]), f.missing).alias(n) for n in names if n not in f.stamps]))
    if not parts:
        raise ValueError("no file has a header")
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return d.limit(rows) if rows else d


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """NaN is null."""
    d = spark.read.parquet(path)
    return d.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in d.dtypes])


def combine_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of rows and columns; in each cell the first frame with a value wins."""
    marked = [d.withColumn("_o", F.lit(i)) for i, d in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return every.groupBy(*keys).agg(*[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_o"))).alias(c) for c in every.columns if c not in (*keys, "_o")])


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_yearly_csv(df: DataFrame, path: str, ts: str = "ts", seconds: float = 1800.0, missing: float = -9999) -> str:
    """One folder a year: compact start and end stamps first, nulls as the missing value."""
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds / 2))
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(missing))).alias(c) for c in df.columns if c != ts]
    out = df.select(F.year(F.col(ts) - half).alias("year"), F.date_format(F.col(ts) - half, "yyyyMMddHHmm").alias("TIMESTAMP_START"), F.date_format(F.col(ts) + half, "yyyyMMddHHmm").alias("TIMESTAMP_END"), *values)
    out.repartition("year").sortWithinPartitions("TIMESTAMP_START").write.mode("overwrite").partitionBy("year").option("header", True).csv(path)
    return path


def write_project(df: DataFrame, folder: str, metadata: dict) -> str:
    """Data as parquet and a manifest beside it."""
    df.write.mode("overwrite").parquet(f"{folder}/data.parquet")
    df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/project.json")
    return folder


def read_project(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/data.parquet"), json.loads(spark.read.text(f"{folder}/project.json").first()[0])
