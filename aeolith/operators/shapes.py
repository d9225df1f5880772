"""What plots show, as tables: contributions, year rings, shifted distributions, ridges, binned scatter, hexagons, date by time grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waterfall(df: DataFrame, keys: list[str], period: str = "day", how: str = "sum", v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, ts, contribution, start, stop): each period's sum or mean, and the running total before and after it. Periods without values are left out."""
    d = df.where(F.col(v).isNotNull()).groupBy(*keys, F.date_trunc(period, ts).cast("timestamp_ntz").alias("ts")).agg((F.sum(v) if how == "sum" else F.avg(v)).alias("contribution"))
    total = F.sum("contribution").over(Window.partitionBy(*keys).orderBy("ts"))
    return d.withColumn("stop", total).withColumn("start", F.col("stop") - F.col("contribution")).select(*keys, "ts", "contribution", "start", "stop")


def year_rings(df: DataFrame, keys: list[str], slots: int = 365, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, year, slot, v): means by year and slot of the year's course, slots numbered from 0."""
    length = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    course = (F.dayofyear(ts) - 1 + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400) / length
    return df.groupBy(*keys, F.year(ts).alias("year"), F.floor(course * slots).cast("int").alias("slot")).agg(F.avg(v).alias("v"))


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with year, doy, fraction (of the day) and doy_time."""
    fraction = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400
    return df.withColumns({"year": F.year(ts), "doy": F.dayofyear(ts), "fraction": fraction, "doy_time": F.dayofyear(ts) + fraction})


def day_grid(df: DataFrame, keys: list[str], minutes: int = 30, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, day, slot, v): a row a day and time of day, slot being the time's number, for heat maps and surfaces."""
    return df.groupBy(*keys, F.to_date(ts).alias("day"), F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int").alias("slot")).agg(F.avg(v).alias("v"))


def density(df: DataFrame, keys: list[str], points: int = 1000, v: str = "v", cells: int = 4096) -> DataFrame:
    """(keys, x, density): a Gaussian kernel density at equal steps from the smallest to the largest value, of bandwidth 1.06 sd n**-0.2.

    Values are counted in cells first, so each point meets a bounded number of cells and not all values.
    """
    s = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count(v).alias("_n"), F.stddev_samp(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    s = s.where("_s > 0").withColumn("_h", 1.06 * F.col("_s") * F.pow("_n", F.lit(-0.2))).withColumn("_w", (F.col("_hi") - F.col("_lo")) / cells)
    d = _alike(df.where(F.col(v).isNotNull()).select(*keys, F.col(v).alias("_v")), s, keys)
    cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(cells - 1))
    c = d.groupBy(*keys, cell.alias("_c")).agg(F.count("*").alias("_m"), F.avg("_v").alias("_at")).groupBy(*keys).agg(F.collect_list(F.struct("_m", "_at")).alias("_cells"))
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / (points - 1))
    g = _alike(grid, c, keys)
    total = F.aggregate("_cells", F.lit(0.0), lambda a, k: a + k["_m"] * F.exp(-0.5 * ((F.col("x") - k["_at"]) / F.col("_h")) ** 2))
    return g.select(*keys, "x", (total / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def _alike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # without keys b is one row


def shifted(df: DataFrame, keys: list[str], reference: tuple[str, str], other: tuple[str, str], v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, zone, low, high, reference, other): shares of both periods' values in zones of the reference's mean and 1 and 3 standard deviations."""
    within = lambda p: F.col(ts).between(F.lit(p[0]).cast("timestamp_ntz"), F.lit(p[1]).cast("timestamp_ntz")) & F.col(v).isNotNull()
    s = df.where(within(reference)).groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    d = _alike(df.where(within(reference) | within(other)), s, keys)
    edges = (float("-inf"), -3, -1, 1, 3, float("inf"))
    zone = sum(((F.col(v) >= F.col("_m") + e * F.col("_s")).cast("int") for e in edges[1:-1]), F.lit(0))
    share = lambda p: F.count_if(within(p)) / F.sum(F.count_if(within(p))).over(Window.partitionBy(*keys))
    at = lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), k) * F.first("_s") + F.first("_m")
    out = d.groupBy(*keys, zone.alias("zone")).agg(at(F.col("zone") + 1).alias("low"), at(F.col("zone") + 2).alias("high"), F.count_if(within(reference)).alias("_r"), F.count_if(within(other)).alias("_o"))
    w = Window.partitionBy(*keys)
    return out.select(*keys, "zone", "low", "high", F.try_divide(F.col("_r"), F.sum("_r").over(w)).alias("reference"), F.try_divide(F.col("_o"), F.sum("_o").over(w)).alias("other"))


def ridges(df: DataFrame, keys: list[str], by: str = "month", points: int = 200, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, group, mean, x, density): a density and the mean of each year, month or week."""
    group = {"year": F.year, "month": F.month, "week": F.weekofyear}[by](ts)
    d = df.withColumn("group", group)
    return density(d, [*keys, "group"], points, v).join(d.groupBy(*keys, "group").agg(F.avg(v).alias("mean")), [*keys, "group"])


def percentile_rank(x: str, keys: list[str] | None = None) -> Column:
    """Average rank of x among its group, in percent."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    below = F.rank().over(w.orderBy(x))
    same = F.count(x).over(Window.partitionBy(*(keys or []), x))
    return (below + (same - 1) / 2) / F.count(x).over(w) * 100


def hexagons(df: DataFrame, x: str, y: str, z: str, size: int = 11, least: int = 1, ranks: bool = False) -> DataFrame:
    """(cx, cy, n, z): median of z in hexagons, size of them along x. ranks puts x and y at their percentile ranks first.

    A point belongs to the nearer of the centres of two shifted rectangular grids.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    if ranks:
        d = d.withColumn("_x", percentile_rank(x)).withColumn("_y", percentile_rank(y))
    else:
        d = d.withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    e = d.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    rows = max(1, int(size / math.sqrt(3)))
    d = d.crossJoin(F.broadcast(e)).withColumn("_u", (F.col("_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * size).withColumn("_v", (F.col("_y") - F.col("_y0")) / (F.col("_y1") - F.col("_y0")) * rows)
    i1, j1, i2, j2 = F.round("_u"), F.round("_v"), F.floor("_u") + 0.5, F.floor("_v") + 0.5
    d1, d2 = (F.col("_u") - i1) ** 2 + 3 * (F.col("_v") - j1) ** 2, (F.col("_u") - i2) ** 2 + 3 * (F.col("_v") - j2) ** 2
    d = d.withColumn("_i", F.when(d1 < d2, i1).otherwise(i2)).withColumn("_j", F.when(d1 < d2, j1).otherwise(j2))
    out = d.groupBy("_i", "_j").agg(F.count("*").alias("n"), F.percentile(z, F.lit(0.5)).alias("z"), *[F.first(c).alias(c) for c in ("_x0", "_x1", "_y0", "_y1")]).where(F.col("n") >= least)
    return out.select((F.col("_x0") + F.col("_i") / size * (F.col("_x1") - F.col("_x0"))).alias("cx"), (F.col("_y0") + F.col("_j") / rows * (F.col("_y1") - F.col("_y0"))).alias("cy"), "n", "z")


def lag_ranges(df: DataFrame, keys: list[str], lag: str, fringe: tuple[int, int] = (0, 0), start: float = 0.0, stop: float = 10.0, gradient: float = 0.15, step: float = 0.05) -> DataFrame:
    """(keys, peak, peak_min, peak_max, window_min, window_max) of a time lag.

    Each distinct value but the last opens a bin. From the fullest bin outwards, the range ends at the first bin where the
    slope of the counts, as shares of the largest, is below gradient, and is widened by a step on each side.
    """
    c = df.where(F.col(lag).isNotNull()).groupBy(*keys, F.col(lag).cast("double").alias("_b")).agg(F.count("*").alias("_n"))
    order, whole = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys)
    c = c.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.count("*").over(whole))
    c = c.withColumn("_n", F.when(F.col("_r") == F.col("_k") - 1, F.col("_n") + F.lead("_n").over(order)).otherwise(F.col("_n"))).where("_r < _k OR _k = 1")
    trim = F.col("_k") - 1 > fringe[0] + fringe[1]
    c = c.where(~trim | ((F.col("_r") > fringe[0]) & (F.col("_r") <= F.col("_k") - 1 - fringe[1])))
    peak = F.first("_b").over(whole.orderBy(F.desc("_n"), "_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = c.withColumn("peak", peak)
    inside = F.col("_b").between(start, stop)
    c = c.withColumn("_any", F.max(inside.cast("int")).over(whole)).where(inside | (F.col("_any") == 0))
    c = c.withColumn("_s", F.col("_n") / F.max("_n").over(whole))
    before, after = F.lag("_s").over(order), F.lead("_s").over(order)
    slope = F.when(before.isNull(), after - F.col("_s")).when(after.isNull(), F.col("_s") - before).otherwise((after - before) / 2)
    c = c.withColumn("_g", F.abs(slope)).withColumn("_at", F.min_by("_b", F.abs(F.col("_b") - F.col("peak"))).over(whole))
    flat = F.col("_g") < gradient
    out = c.groupBy(*keys).agg(
        F.first("peak").alias("peak"), F.coalesce(F.max(F.when(flat & (F.col("_b") < F.col("_at")), F.col("_b"))), F.first("_at")).alias("peak_min"),
        F.coalesce(F.min(F.when(flat & (F.col("_b") > F.col("_at")), F.col("_b"))), F.first("_at")).alias("peak_max"),
    )
    return out.withColumn("window_min", F.col("peak_min") - step).withColumn("window_max", F.col("peak_max") + step)

