"""The time axis: cleaning stamps, finding the step, regular grids, stamp conventions. Stamps are naive (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONVENTIONS = ("START", "MIDDLE", "END")


def interval(seconds: Column | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds if isinstance(seconds, Column) else F.lit(float(seconds)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def parse_stamps(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Strings to stamps; what can't be read is null."""
    raw = F.col(column)
    return df.withColumn(column, F.try_to_timestamp(raw, F.lit(fmt) if fmt else None).cast("timestamp_ntz"))


def drop_null_stamps(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def drop_duplicate_stamps(df: DataFrame, keys: list[str], order: list, keep: str = "last", ts: str = "ts") -> DataFrame:
    """One row for each stamp of a series: the first or last by order, or with keep='none' only stamps met once."""
    w = Window.partitionBy(*keys, ts)
    if keep == "none":
        return df.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")
    by = [c.desc() if keep == "last" else c.asc() for c in map(F.col, order)]
    return df.withColumn("_n", F.row_number().over(w.orderBy(*by))).where("_n = 1").drop("_n")


def steps(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, step in seconds, n): how often stamps of a series follow each other by a step."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    d = df.select(*keys, seconds_between(F.col(ts), before).alias("step")).where("step IS NOT NULL")
    return d.groupBy(*keys, "step").agg(F.count("*").alias("n"))


def detect_frequency(df: DataFrame, keys: list[str], ts: str = "ts", least_share: float = 0.5) -> DataFrame:
    """(keys, step, share): the most frequent step of each series, the smallest of ties, null if its share isn't above least_share."""
    n = steps(df, keys, ts)
    top = n.groupBy(*keys).agg(F.max_by(F.struct("step", "n"), F.struct("n", -F.col("step"))).alias("t"), F.sum("n").alias("all"))
    share = F.col("t.n") / F.col("all")
    return top.select(*keys, F.when(share > least_share, F.col("t.step")).alias("step"), share.alias("share"))


def non_monotonic(df: DataFrame, keys: list[str], order: str, ts: str = "ts") -> DataFrame:
    """(keys, n): how many rows of a series, in order, don't come later than the row before."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, (F.col(ts) <= before).alias("_bad")).groupBy(*keys).agg(F.count_if("_bad").alias("n"))


def regularize(df: DataFrame, keys: list[str], step: float, ts: str = "ts") -> DataFrame:
    """Every series on its full grid from first to last stamp: missing stamps become null rows, stamps off the grid go."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_z", interval(step))).alias(ts))
    return grid.join(df, [*keys, ts], "left")


def to_middle(stamp: Column, convention: str, step: float) -> Column:
    return {"END": stamp - interval(step / 2), "START": stamp + interval(step / 2), "MIDDLE": stamp}[convention]


def convert_convention(stamp: Column, have: str, want: str, step: float) -> Column:
    """A stamp of one convention as another's, for intervals of step seconds."""
    return stamp + interval((CONVENTIONS.index(want) - CONVENTIONS.index(have)) * step / 2)


def shift_hours(stamp: Column, hours: float) -> Column:
    """To a fixed offset; never a named zone."""
    return stamp + interval(hours * 3600)


def keep_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included; None leaves a side open."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("start is after end")
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz")) if end is not None else df


def keep_years(df: DataFrame, first: int | None = None, last: int | None = None, ts: str = "ts") -> DataFrame:
    """As ranges of stamps, which reach the scan."""
    if first is not None:
        df = df.where(F.col(ts) >= F.lit(f"{first}-01-01").cast("timestamp_ntz"))
    return df.where(F.col(ts) < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz")) if last is not None else df


def before_day_of_year(df: DataFrame, month_day: str, value: str, ts: str = "ts") -> DataFrame:
    """Rows up to MM-DD of each year with a value."""
    return df.where((F.date_format(ts, "MM-dd") <= month_day) & F.col(value).isNotNull())


def neighbouring_years(df: DataFrame, ts: str = "ts", more: int = 2) -> DataFrame:
    """Rows once for each pool year: the year and the nearest others up to ``more``, with all years between; at most a few copies of a row."""
    years = df.select(F.year(ts).alias("y")).distinct()
    near = years.select(F.col("y").alias("pool_year")).join(years, F.col("y").between(F.col("pool_year") - 50, F.col("pool_year") + 50))
    w = Window.partitionBy("pool_year").orderBy(F.abs(F.col("y") - F.col("pool_year")), "y")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= more + 1)
    pools = near.groupBy("pool_year").agg(F.min("y").alias("a"), F.max("y").alias("z")).select("pool_year", F.explode(F.sequence("a", "z")).alias("_y"))
    return df.withColumn("_y", F.year(ts)).join(pools, "_y").drop("_y")


def sanitize(df: DataFrame, keys: list[str], order: list, step: float, ts: str = "ts", convention: str = "MIDDLE") -> DataFrame:
    """Null stamps out, the last of duplicates kept, the full grid, stamps in the middle."""
    d = regularize(drop_duplicate_stamps(drop_null_stamps(df, ts), keys, order, "last", ts), keys, step, ts)
    return d.withColumn(ts, to_middle(F.col(ts), convention, step))


def frequency_of_ends(df: DataFrame, keys: list[str], most: int = 1000, least: int = 4, ts: str = "ts") -> DataFrame:
    """(keys, step, n): the step in seconds that the first n and the last n stamps keep, n being the largest from most down to least for which there are twice as many; null without."""
    w, back = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys).orderBy(F.desc(ts))
    d = df.select(*keys, ts).withColumn("step", seconds_between(F.col(ts), F.lag(ts).over(w))).withColumn("a", F.row_number().over(w)).withColumn("z", F.row_number().over(back))
    ends = d.groupBy(*keys).agg(F.count("*").alias("rows"), F.min_by("step", F.when(F.col("a") > 1, F.col("a"))).alias("first"), F.min_by("step", F.when(F.col("a") > 1, F.col("z"))).alias("last"))
    near = d.where((F.col("a") <= most) | (F.col("z") <= most)).join(ends, keys)
    # how many stamps from each end keep that end's step: one less than the stamp before which it changes
    run = near.groupBy(*keys).agg(
        F.first("rows").alias("rows"), F.first("first").alias("first"), F.first("last").alias("last"), F.min(F.when((F.col("a") > 1) & (F.col("step") != F.col("first")), F.col("a"))).alias("x"),
        F.min(F.when((F.col("a") > 1) & (F.col("step") != F.col("last")), F.col("z"))).alias("y"),
    )
    n = F.least(F.lit(most), F.floor(F.col("rows") / 2), F.coalesce(F.col("x") - 1, F.lit(most)), F.coalesce(F.col("y"), F.lit(most))).cast("int")
    good = (F.col("first") == F.col("last")) & (n >= least)
    return run.select(*keys, F.when(good, F.col("first")).alias("step"), F.when(good, n).alias("n"))


def stamps_by_number(df: DataFrame, keys: list[str], order: str, start: str, seconds: float, duration: float) -> DataFrame:
    """df with ts: a file's start and each record's number times the true resolution, which is the duration over the records found if there are others than expected; rounded to 50 ms."""
    expected = int(duration / seconds)
    n = F.count("*").over(Window.partitionBy(*keys))
    step = F.when(n == expected, F.lit(float(seconds))).otherwise(F.lit(float(duration)) / n)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("ts", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.rint(number * step / 0.05) * 0.05)).cast("timestamp_ntz"))


def seconds_of(n: int, unit: str) -> float:
    """Seconds of n units: s, min, h, D, W."""
    return n * {"s": 1.0, "min": 60.0, "h": 3600.0, "D": 86400.0, "W": 604800.0}[unit]


def unix_now() -> int:
    """Seconds since 1970, now."""
    import time

    return int(time.time())
