"""Clock errors and sensor offsets, found against a reference."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _phase(v: str, ts: str) -> Column:
    a = (F.hour(ts) * 60 + F.minute(ts)) * (2 * math.pi / 1440)
    return F.atan2(F.sum(F.col(v) * F.sin(a)), F.sum(F.col(v) * F.cos(a)))


def phase_shift(df: DataFrame, keys: list[str], measured: str, potential: str, least_share: float = 0.9, least_clearness: float = 0.6, ts: str = "ts") -> DataFrame:
    """(keys, day, minutes): by how much the daily cycle of a measurement runs late of its potential, from the first harmonics; clear and nearly complete days only."""
    d = df.where(F.col(potential).isNotNull()).withColumn("_m", F.col(measured)).groupBy(*keys, F.to_date(ts).alias("day"))
    both = F.when(F.col(measured).isNotNull(), F.col(potential))
    d = d.agg((F.count(measured) / F.count("*")).alias("share"), F.try_divide(F.sum(measured), F.sum(both)).alias("clear"), _phase(measured, ts).alias("a"), _phase(potential, ts).alias("b"))
    turn = F.col("a") - F.col("b")
    turn = turn - 2 * math.pi * F.rint(turn / (2 * math.pi))
    return d.where((F.col("share") >= least_share) & (F.col("clear") >= least_clearness)).select(*keys, "day", (turn * 1440 / (2 * math.pi)).alias("minutes"))


def noon_shift(df: DataFrame, keys: list[str], measured: str, potential: str, ts: str = "ts") -> DataFrame:
    """(keys, day, minutes): from the daily maximum of the potential to that of the measurement, the earlier of equal ones."""
    first = lambda v: F.max_by(ts, F.struct(F.col(v), -F.unix_micros(F.col(ts).cast("timestamp"))))
    d = df.where(F.col(measured).isNotNull() & F.col(potential).isNotNull()).groupBy(*keys, F.to_date(ts).alias("day")).agg(first(measured).alias("a"), first(potential).alias("b"))
    return d.select(*keys, "day", (F.timestamp_diff("SECOND", F.col("b"), F.col("a")) / 60).alias("minutes"))


def lag_shift(df: DataFrame, keys: list[str], measured: str, potential: str, most: int = 4, ts: str = "ts") -> DataFrame:
    """(keys, day, lag): records by which the measurement must be moved back for the best correlation within the day; the smallest of equal lags."""
    from aeolith.operators.stats import correlation

    w = Window.partitionBy(*keys).orderBy(ts)
    lags = range(-most, most + 1)
    d = df.withColumns({f"_{i}": (F.lead(measured, k) if k >= 0 else F.lag(measured, -k)).over(w) for i, k in enumerate(lags)})
    d = d.groupBy(*keys, F.to_date(ts).alias("day")).agg(*[correlation(f"_{i}", potential).alias(f"r{i}") for i in range(len(lags))])
    best = F.array_max(F.array(*[F.struct(F.round(f"r{i}", 9).alias("r"), F.lit(-abs(k)).alias("a"), F.lit(k).alias("lag")) for i, k in enumerate(lags)]))
    return d.select(*keys, "day", best["lag"].alias("lag"), best["r"].alias("r")).where("r IS NOT NULL")


def wind_direction_offset(df: DataFrame, direction: str, reference: list[int], ts: str = "ts", lo: int = -100, hi: int = 100) -> DataFrame:
    """(year, offset): the whole-degree turn after which a year's histogram of directions correlates best with that of the reference years. Works on 360 counts a year."""
    bins = df.where(F.col(direction).isNotNull()).groupBy(F.year(ts).alias("year"), F.pmod(F.floor(direction), F.lit(360)).cast("int").alias("deg")).count()
    ref = bins.where(F.col("year").isin(reference)).groupBy("deg").agg(F.sum("count").alias("count")).withColumn("year", F.lit(None).cast("int"))
    both = bins.join(F.broadcast(ref.groupBy().agg(F.collect_list(F.struct("deg", "count")).alias("ref"))), F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros(360), np.zeros(360)
        a[pdf["deg"]] = pdf["count"]
        for r in pdf["ref"].iloc[0]:
            b[r["deg"]] = r["count"]
        r = [np.corrcoef(np.roll(a, k), b)[0, 1] if a.std() and b.std() else 0.0 for k in range(lo, hi)]
        return pd.DataFrame({"year": [int(pdf["year"].iloc[0])], "offset": [lo + int(np.argmax(r))]})

    return both.groupBy("year").applyInPandas(run, "year int, offset int")
