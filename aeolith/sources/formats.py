"""Files and layouts around the data: searches, headers, archives, upload formats, single-file tables."""

from __future__ import annotations

import fnmatch
import os
import pickle
import zipfile
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.functions.names import check_stamp_name, stamp_convention
from aeolith.sources.files import FORMATS, TextFormat, unique_names


def find_files(folders: str | list[str], pattern: str) -> list[str]:
    """Sorted paths of files below folders whose name fits a pattern. Local folders, on the driver."""
    roots = [folders] if isinstance(folders, str) else folders
    return sorted(os.path.join(at, n) for r in roots for at, _, files in os.walk(r) for n in files if fnmatch.fnmatch(n, pattern))


def find_folders(folders: str | list[str]) -> list[str]:
    roots = [folders] if isinstance(folders, str) else folders
    return sorted(os.path.join(at, n) for r in roots for at, names, _ in os.walk(r) for n in names)


def find_remote(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The same for any store that Spark reads, by its own listing."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return sorted(r.path for r in d.select("path").collect())


def make_folder(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def out_path(folder: str | None, name: str, extension: str) -> str:
    return os.path.join(folder or "", f"{name}.{extension.lstrip('.')}")


def unzip(path: str) -> str:
    """The first csv of an archive, written beside it; names that lead out of the folder are refused."""
    with zipfile.ZipFile(path) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".csv"))
        target = os.path.join(os.path.dirname(path), os.path.basename(name))
        with z.open(name) as src, open(target, "wb") as dst:
            while chunk := src.read(1 << 20):
                dst.write(chunk)
    return target


def write_pickle(df: DataFrame, path: str, most: int = 5_000_000) -> str:
    """A small table as a pickled pandas frame; larger ones than most rows raise, as they would have to fit the driver."""
    if df.count() > most:
        raise ValueError(f"more than {most} rows; write parquet instead")
    with open(path, "wb") as f:
        pickle.dump(df.toPandas(), f)
    return path


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """Only for files of one's own: reading a pickle runs what it says."""
    with open(path, "rb") as f:
        return spark.createDataFrame(pickle.load(f))


def checked_layout(config: dict) -> TextFormat:
    """A layout from its declaration; unknown keys raise, ``-not-available-`` and ``None`` stand for nothing."""
    known = {f.name for f in fields(TextFormat)}
    if unknown := set(config) - known:
        raise ValueError(f"not part of a layout: {sorted(unknown)}")
    given = {k: v for k, v in config.items() if v not in ("-not-available-", "None", None)}
    for k in ("stamps", "missing"):
        if isinstance(given.get(k), str):
            given[k] = (given[k],)
    return TextFormat(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def variant(name: str, **changes) -> TextFormat:
    """A known layout with changes."""
    return replace(FORMATS[name], **changes)


def header(spark: SparkSession, path: str, layout: TextFormat, units_row: int | None = None) -> tuple[list[str], list[str]]:
    """Names and units (empty where there is no such row) of a file."""
    rows = spark.read.text(path).limit(layout.skip + layout.header).collect()
    names = [x.strip() for x in rows[layout.skip].value.split(layout.delimiter)]
    units = [x.strip() for x in rows[layout.skip + units_row].value.split(layout.delimiter)] if units_row is not None else [""] * len(names)
    return names, units


def width(spark: SparkSession, path: str, layout: TextFormat) -> int:
    """Columns of the first row of data."""
    rows = spark.read.text(path).limit(layout.skip + layout.header + 1).collect()
    return len(rows[layout.skip + layout.header].value.split(layout.delimiter)) if len(rows) > layout.skip + layout.header else 0


def fitted_header(names: list[str], columns: int) -> list[str]:
    """A name for each of so many columns: unknown-N where the header ends early, repeats told apart."""
    return unique_names((names + [""] * columns)[: max(columns, len(names))])


def stamped(df: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """df with its stamp under one of the reserved names."""
    stamp_convention(name)
    return df.withColumnRenamed(ts, name)


def formatted_stamp(df: DataFrame, name: str, convention: str, pattern: str | None = None, seconds: float = 1800.0, have: str = "end", ts: str = "ts") -> DataFrame:
    """df with a stamp column of a convention (end, middle, start), as text by a pattern if one is given. have is the convention of ts."""
    check_stamp_name(name, convention)
    place = {"start": 0.0, "middle": 0.5, "end": 1.0}
    x = F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit((place[convention] - place[have]) * seconds))
    return df.withColumn(name, F.date_format(x, pattern) if pattern else x)


def for_flux_processing(df: DataFrame, columns: dict[str, tuple[str, str]], missing: float = -9999, ts: str = "ts") -> DataFrame:
    """Meteorological data as flux software takes them: date, time, then columns under ``name|unit``; stamps at the end of half hours, which must be regular."""
    steps = df.select((F.unix_micros(F.col(ts).cast("timestamp")) % 1_800_000_000).alias("r")).where("r <> 0")
    if not steps.isEmpty():
        raise ValueError("stamps are not on half hours")
    values = [F.coalesce(F.col(f"`{old}`").cast("double"), F.lit(float(missing))).alias(f"{name}|{unit}") for old, (name, unit) in columns.items()]
    return df.select(F.date_format(ts, "yyyy-MM-dd").alias("TIMESTAMP_1|yyyy-mm-dd"), F.date_format(ts, "HH:mm").alias("TIMESTAMP_2|HH:MM"), *values)


def for_upload(df: DataFrame, columns: dict[str, str], seconds: float = 1800.0, missing: float = -9999, ts: str = "ts") -> DataFrame:
    """Meteorological data for upload: compact start and end stamps, columns under their new names, missing values filled."""
    start = F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    values = [F.coalesce(F.col(f"`{old}`").cast("double"), F.lit(float(missing))).alias(new) for old, new in columns.items()]
    return df.select(F.date_format(start, "yyyyMMddHHmm").alias("TIMESTAMP_START"), F.date_format(ts, "yyyyMMddHHmm").alias("TIMESTAMP_END"), *values)


def is_project(spark: SparkSession, folder: str) -> bool:
    """Does the folder have a project's manifest?"""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/project.json")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))
