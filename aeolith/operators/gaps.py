"""Runs of missing values, and short ones filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators.timeaxis import seconds_between


def _islands(df: DataFrame, keys: list[str], ts: str, v: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("_i", F.count(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def find_gaps(df: DataFrame, keys: list[str], least: int | None = None, most: int | None = None, ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, gap_start, gap_end, length, seconds): runs of nulls; seconds is length times the median step."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    step = df.select(*keys, seconds_between(F.col(ts), before).alias("d")).groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("step"))
    g = _islands(df, keys, ts, v).where(F.col(v).isNull()).groupBy(*keys, "_i").agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count("*").alias("length"))
    g = g.where(F.col("length") >= least) if least else g
    g = g.where(F.col("length") <= most) if most else g
    return g.join(step, keys).select(*keys, "gap_start", "gap_end", "length", (F.col("length") * F.col("step")).alias("seconds"))


def count_gaps(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    before = F.lag(F.col(v).isNull(), 1, False).over(Window.partitionBy(*keys).orderBy(ts))
    return df.select(*keys, (F.col(v).isNull() & ~before).alias("g")).groupBy(*keys).agg(F.count_if("g").alias("n_gaps"))


def gap_statistics(df: DataFrame, keys: list[str], long: int = 48, ts: str = "ts", v: str = "v") -> DataFrame:
    """By year and month of a series: records, missing, share missing, gaps that begin there, and long ones among them."""
    month = [F.year(ts).alias("year"), F.month(ts).alias("month")]
    m = df.groupBy(*keys, *month).agg(F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("missing"))
    g = find_gaps(df, keys, ts=ts, v=v).groupBy(*keys, F.year("gap_start").alias("year"), F.month("gap_start").alias("month"))
    g = g.agg(F.count("*").alias("gaps"), F.count_if(F.col("length") >= long).alias("long_gaps"), F.max("length").alias("longest"))
    out = m.join(g, [*keys, "year", "month"], "left")
    zero = F.lit(0).cast("long")
    return out.select(*keys, "year", "month", "n", "missing", (F.col("missing") / F.col("n") * 100).alias("missing_percent"), F.coalesce("gaps", zero).alias("gaps"), F.coalesce("long_gaps", zero).alias("long_gaps"), F.coalesce("longest", zero).alias("longest"))


def interpolate(df: DataFrame, keys: list[str], most: int = 3, ts: str = "ts", v: str = "v") -> DataFrame:
    """Gaps of at most ``most`` records filled linearly by record number; longer ones and the ends stay null. New column: filled."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("_r", F.row_number().over(w))
    known = F.when(F.col(v).isNotNull(), F.struct(F.col("_r").alias("r"), F.col(v).alias("x")))
    d = d.withColumn("_a", F.last(known, True).over(back)).withColumn("_z", F.first(known, True).over(on))
    gap = F.col("_z.r") - F.col("_a.r") - 1
    line = F.col("_a.x") + (F.col("_z.x") - F.col("_a.x")) * (F.col("_r") - F.col("_a.r")) / F.when(gap >= 0, gap + 1)
    return d.withColumn("filled", F.when(F.col(v).isNotNull(), F.col(v)).when(gap <= most, line)).drop("_r", "_a", "_z")


def trim_to_valid(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """Rows from the first to the last value of a series."""
    ends = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    return df.join(ends, keys).where(F.col(ts).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def gap_at(gaps: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The gap of each series nearest to a moment: the one around it, else the one with the nearer end, the earlier of two."""
    moment = F.lit(at).cast("timestamp_ntz")
    micros = lambda c: F.timestamp_diff("MICROSECOND", moment, c)
    away = F.greatest(micros(F.col("gap_start")), -micros(F.col("gap_end")), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(away, "gap_start")
    return gaps.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
