"""Columns of a frame: choosing, comparing, renaming and ordering them; a second header level is the part of a name after a bar, as in ``TA|degC``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR = "|"


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns named; ValueError if some are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def new_columns(df: DataFrame, other: DataFrame, keys: list[str]) -> list[str]:
    """Columns that other has not; ValueError if rows of equal keys differ in those that both have."""
    both = [c for c in df.columns if c in other.columns and c not in keys]
    same = lambda d: d.select(*keys, F.struct(*[F.col(f"`{c}`") for c in both]).alias("_v")) if both else d.select(*keys)
    if both and not same(df).withColumnRenamed("_v", "_a").join(same(other), keys).where(~F.col("_a").eqNullSafe(F.col("_v"))).isEmpty():
        raise ValueError("shared columns differ")
    return [c for c in df.columns if c not in other.columns]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def with_units(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns under a name and a unit; those not named keep theirs and get a dash."""
    return df.withColumnsRenamed({c: BAR.join(names.get(c, (c, "-"))) for c in df.columns})


def flatten(df: DataFrame, first_only: bool = False) -> DataFrame:
    """One header level: both parts joined by an underscore, or the first alone, which must stay unique."""
    names = {c: c.split(BAR)[0] if first_only else c.replace(BAR, "_") for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError("names would no longer differ")
    return df.withColumnsRenamed(names)


def ordered(df: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    """Columns by name without regard to case: those that begin with a stop, then those named in first, then the rest."""
    name = lambda c: c.split(BAR)[0]
    return keep(df, sorted(df.columns, key=lambda c: (not name(c).startswith("."), name(c) not in first, name(c).lower())))


def to_arrays(df: DataFrame, target: str, ts: str = "ts", complete: bool = True, most: int = 5_000_000) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(targets, features, names of features, stamps) on the driver, complete rows only if so wished; ValueError beyond most rows."""
    names = [c for c in df.columns if c not in (target, ts)]
    d = df.dropna() if complete else df
    if d.count() > most:
        raise ValueError(f"more than {most} rows")
    t = d.orderBy(ts).toPandas()
    return t[target].to_numpy(), t[names].to_numpy(), names, t[ts].to_numpy()


def uniform(seed: int, *by: str) -> Column:
    """Numbers from 0 to 1 by hash of columns: the same for the same row, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *by: str) -> Column:
    """Standard normal numbers by hash of columns."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *by))) * F.cos(2 * np.pi * uniform(seed + 1, *by))


def made_series(spark, periods: int = 365, seconds: float = 86400.0, start: str = "2024-01-01", slope: float = 0.05, seasonal: float = 5.0, noise: float = 2.0, outliers: float = 0.02, seed: int = 42) -> DataFrame:
    """(ts, base_signal, noise, observed_value): a trend, a wave, normal noise, and a share of outliers of 5 to 10 times the noise. By hash, so every row is made where it is."""
    d = spark.range(periods).withColumn("ts", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * seconds)).cast("timestamp_ntz"))
    base = slope * F.col("id") + seasonal * F.sin(F.col("id") * 50 / max(periods - 1, 1))
    d = d.withColumn("base_signal", base).withColumn("noise", noise * normal(seed, "id"))
    spike = F.when(uniform(seed + 2, "id") < outliers, F.when(uniform(seed + 3, "id") < 0.5, -1).otherwise(1) * noise * (5 + 5 * uniform(seed + 4, "id"))).otherwise(0.0)
    return d.select("ts", "base_signal", "noise", (F.col("base_signal") + F.col("noise") + spike).alias("observed_value"))


def impulse_noise(df: DataFrame, keys: list[str], low: float = -10, high: float = 10, share: float = 0.04, seed: int = 42, v: str = "v", ts: str = "ts") -> DataFrame:
    """df with noisy: about a share of the values moved by a number between low times the least and high times the largest value, both without sign."""
    e = df.groupBy(*keys).agg((low * F.abs(F.min(v))).alias("_lo"), (high * F.abs(F.max(v))).alias("_hi"))
    d = df.join(F.broadcast(e), keys) if keys else df.crossJoin(F.broadcast(e))
    move = F.when(uniform(seed, *keys, ts) < share, F.col("_lo") + uniform(seed + 1, *keys, ts) * (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return d.withColumn("noisy", F.col(v) + move).drop("_lo", "_hi")
