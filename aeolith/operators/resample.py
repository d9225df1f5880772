"""Tumbling time buckets, diel and calendar aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators.timeaxis import interval


def bucket(ts: str, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")


def resample(df: DataFrame, keys: list[str], seconds: int, agg: str = "avg", least_share: float = 0.9, label: str = "end", ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, ts, v): avg or sum by bucket, where it holds at least int(share of the fullest bucket) values, or one if that is below 3; grid restored with nulls."""
    b = df.groupBy(*keys, bucket(ts, seconds).alias("w")).agg(F.expr(f"{agg}({v})").alias("x"), F.count(v).alias("n"))
    least = F.floor(F.max("n").over(Window.partitionBy(*keys)) * least_share)
    b = b.withColumn("least", F.when(least < 3, 1).otherwise(least))
    at = {"start": F.col("w.start"), "end": F.col("w.end"), "middle": F.col("w.start") + interval(seconds / 2)}[label]
    b = b.select(*keys, at.alias(ts), F.when(F.col("n") >= F.col("least"), F.col("x")).alias(v))
    from aeolith.operators.timeaxis import regularize

    return regularize(b, keys, seconds, ts)


def daily(df: DataFrame, keys: list[str], agg: str = "avg", least_share: float = 0.0, ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, day, v): days that hold at least max(1, int(share of the fullest day)) values."""
    d = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.expr(f"{agg}({v})").alias("x"), F.count(v).alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.max("n").over(Window.partitionBy(*keys)) * least_share))
    return d.where(F.col("n") >= 1).withColumn("least", least).where("n >= least").select(*keys, "day", F.col("x").alias(v))


def month_matrix(df: DataFrame, agg: str = "avg", ts: str = "ts", v: str = "v") -> DataFrame:
    """One row a year, one column a month."""
    return df.groupBy(F.year(ts).alias("year")).pivot("_m", list(range(1, 13))).agg(F.expr(f"{agg}({v})")) if "_m" in df.columns else df.withColumn("_m", F.month(ts)).groupBy(F.year(ts).alias("year")).pivot("_m", list(range(1, 13))).agg(F.expr(f"{agg}({v})"))


def month_ranks(df: DataFrame, agg: str = "avg", ts: str = "ts", v: str = "v") -> DataFrame:
    """(year, month, v, rank): rank 1 for the highest year of a calendar month, ties alike."""
    m = df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.expr(f"{agg}({v})").alias(v))
    return m.withColumn("rank", F.dense_rank().over(Window.partitionBy("month").orderBy(F.round(v, 9).desc())))


def long_months(matrix: DataFrame) -> DataFrame:
    """A month matrix as (year, month, v), missing months null."""
    return matrix.unpivot("year", [str(m) for m in range(1, 13)], "month", "v").withColumn("month", F.col("month").cast("int"))


def diel_cycle(df: DataFrame, keys: list[str], least: int = 1, by_month: bool = False, ts: str = "ts", v: str = "v") -> DataFrame:
    """Statistics by time of day, or month and time of day; null where fewer than least values."""
    by = [*keys, *(["month"] if by_month else []), "time"]
    d = df.withColumn("month", F.month(ts)).withColumn("time", F.date_format(ts, "HH:mm:ss")).groupBy(*by)
    d = d.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"), F.min(v).alias("min"), F.max(v).alias("max"))
    keep = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return d.select(*by, "n", *[keep(c) for c in ("mean", "sd", "median", "q25", "q75", "min", "max")], keep("mean").alias("_m")).withColumn("mean_plus_sd", F.col("_m") + F.col("sd")).withColumn("mean_minus_sd", F.col("_m") - F.col("sd")).drop("_m")


def broadcast_aggregate(df: DataFrame, keys: list[str], period: str = "DAY", agg: str = "avg", ts: str = "ts", v: str = "v", name: str = "aggregate") -> DataFrame:
    """Every row with its period's aggregate."""
    return df.withColumn(name, F.expr(f"{agg}({v})").over(Window.partitionBy(*keys, F.date_trunc(period, F.col(ts)))))


def yearly_cumulatives(df: DataFrame, ts: str = "ts", v: str = "v") -> DataFrame:
    """(year, doy_time, cumulative): running sums within years; null values stay null and are skipped."""
    fraction = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400
    d = df.select(F.year(ts).alias("year"), (F.dayofyear(ts) + fraction).alias("doy_time"), F.col(v).alias("v"))
    w = Window.partitionBy("year").orderBy("doy_time").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("year", "doy_time", F.when(F.col("v").isNotNull(), F.sum("v").over(w)).alias("cumulative"))


def mean_cumulative(cumulatives: DataFrame, leave_out: list[int] | None = None) -> DataFrame:
    """Mean and spread over years of cumulatives at each time of year."""
    c = cumulatives.where(~F.col("year").isin(leave_out)) if leave_out else cumulatives
    m = c.groupBy("doy_time").agg(F.avg("cumulative").alias("mean"), F.stddev_samp("cumulative").alias("sd"))
    return m.select("*", (F.col("mean") + F.col("sd")).alias("plus_sd"), (F.col("mean") - F.col("sd")).alias("minus_sd"), (F.col("mean") + 1.96 * F.col("sd")).alias("plus_ci"), (F.col("mean") - 1.96 * F.col("sd")).alias("minus_ci"))


def long_term_anomalies(df: DataFrame, first: int, last: int, agg: str = "avg", ts: str = "ts", v: str = "v") -> DataFrame:
    """(year, v, anomaly): yearly values less the mean over the reference years; years without data are null rows."""
    y = df.groupBy(F.year(ts).alias("year")).agg(F.expr(f"{agg}({v})").alias(v))
    ends = y.agg(F.min("year").alias("a"), F.max("year").alias("z"), F.avg(F.when(F.col("year").between(first, last), F.col(v))).alias("reference"))
    grid = ends.select("reference", F.explode(F.sequence("a", "z")).alias("year"))
    return grid.join(y, "year", "left").select("year", v, (F.col(v) - F.col("reference")).alias("anomaly"))
