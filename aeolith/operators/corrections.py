"""Corrections of values and selections of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap(v: Column, limit: float, at: str) -> Column:
    """Nothing above ('max') or below ('min') the limit."""
    return F.when(v > limit, F.lit(limit)).otherwise(v) if at == "max" else F.when(v < limit, F.lit(limit)).otherwise(v)


def set_between(v: Column, ts: Column, ranges: list, value: float) -> Column:
    inside = reduce(lambda a, b: a | b, [ts.between(F.lit(a).cast("timestamp_ntz"), F.lit(z).cast("timestamp_ntz")) for a, z in ranges])
    return F.when(inside, F.lit(value)).otherwise(v)


def exact_to_missing(v: Column, values: list[float]) -> Column:
    return F.when(~v.isin(values), v)


def keep_where(target: Column, condition: Column, lo: float | None = None, hi: float | None = None, inclusive: str = "both", invert: bool = False) -> Column:
    """target where condition lies in the range, else null; a null condition only passes when inverted."""
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (condition >= lo if inclusive in ("both", "left") else condition > lo)
    if hi is not None:
        inside = inside & (condition <= hi if inclusive in ("both", "right") else condition < hi)
    inside = F.coalesce(inside & condition.isNotNull(), F.lit(False))
    return F.when(~inside if invert else inside, target)


def combine(a: Column, b: Column, method: str) -> Column:
    """Sum, difference, product, quotient (infinite on division by zero, as IEEE has it) or a filled by b."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.when(b == 0, inf).otherwise(F.try_divide(a, b)), "fillgaps": F.coalesce(a, b)}[method]


def humidity_offset(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """Daily mean of what exceeds 100, less 100, interpolated over days that have none (nearest beyond the ends), taken off; capped at 100."""
    from aeolith.operators.gaps import interpolate

    d = df.withColumn("day", F.to_date(ts))
    days = d.groupBy(*keys, "day").agg((F.avg(F.when(F.col(v) > 100, F.col(v))) - 100).alias("o"))
    days = interpolate(days, keys, 1 << 30, "day", "o")
    w = Window.partitionBy(*keys).orderBy("day")
    offset = F.coalesce("filled", F.last("filled", True).over(w), F.first("filled", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    days = days.select(*keys, "day", offset.alias("offset"))
    return d.join(days, [*keys, "day"]).withColumn("corrected", F.least(F.col(v) - F.col("offset"), F.when(F.col(v).isNotNull(), F.lit(100.0)))).drop("day")


def night_offset(df: DataFrame, keys: list[str], night: Column, ts: str = "ts", v: str = "v") -> DataFrame:
    """The daily mean at night is taken off, the series' median of it where a day has none; nights become 0 and nothing stays below 0."""
    day = Window.partitionBy(*keys, F.to_date(ts))
    d = df.withColumn("_n", night).withColumn("_o", F.avg(F.when(F.col("_n"), F.col(v))).over(day))
    d = d.withColumn("_o", F.coalesce("_o", F.percentile("_o", F.lit(0.5)).over(Window.partitionBy(*keys))))
    x = F.when(F.col("_n"), F.lit(0.0)).otherwise(F.greatest(F.col(v) - F.col("_o"), F.lit(0.0)))
    return d.withColumn("corrected", F.when(F.col(v).isNotNull(), x)).withColumn("offset", F.col("_o")).drop("_n", "_o")


def offset_from_replicate(df: DataFrame, keys: list[str], measured: str, replicate: str, lo: float = -100, hi: float = 100, step: float = 0.1) -> DataFrame:
    """The offset on the grid with the least sum of |measured + offset - replicate|: the grid point nearest the median difference."""
    m = df.groupBy(*keys).agg(F.percentile(F.col(replicate) - F.col(measured), F.lit(0.5)).alias("m"))
    return m.select(*keys, F.least(F.greatest(F.rint((F.col("m") - lo) / step) * step + lo, F.lit(float(lo))), F.lit(float(hi))).alias("offset"))


def event_flag(ts: Column, start: str, end: str) -> Column:
    return F.when(ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), 1).otherwise(0)


def nearest_record(df: DataFrame, keys: list[str], at: str, ts: str = "ts") -> DataFrame:
    """1 at the record nearest a moment, the earlier of two, else 0."""
    moment = F.lit(at).cast("timestamp_ntz")
    gap = F.abs(F.timestamp_diff("MICROSECOND", moment, F.col(ts)))
    first = F.min(F.struct(gap.alias("g"), F.col(ts).alias("t"))).over(Window.partitionBy(*keys))
    return df.withColumn("flag", F.when(F.col(ts) == first["t"], 1).otherwise(0))


def apply_all(df: DataFrame, keys: list[str], steps: list[dict], night: Column | None = None, ts: str = "ts", v: str = "v") -> DataFrame:
    """df with v after corrections in their order; each step is its key and its settings. ValueError for keys that aren't known, or a night offset without night."""
    for step in steps:
        key, x = step["key"], F.col(v)
        if key == "setto_max":
            df = df.withColumn(v, cap(x, step["threshold"], "max"))
        elif key == "setto_min":
            df = df.withColumn(v, cap(x, step["threshold"], "min"))
        elif key == "setto_value":
            df = df.withColumn(v, set_between(x, F.col(ts), step["ranges"], step["value"]))
        elif key == "set_exact_to_missing":
            df = df.withColumn(v, exact_to_missing(x, step["values"]))
        elif key == "relativehumidity_offset":
            df = humidity_offset(df, keys, ts, v).withColumn(v, F.col("corrected")).drop("corrected", "offset")
        elif key == "radiation_zero_offset" and night is not None:
            df = night_offset(df, keys, night, ts, v).withColumn(v, F.col("corrected")).drop("corrected", "offset")
        else:
            raise ValueError(f"{key} is no correction, or needs to know the nights")
    return df


def night_offset_report(df: DataFrame, keys: list[str], night: Column, ts: str = "ts", v: str = "v") -> DataFrame:
    """(keys, n_night, below_before, below_before_night, below_after, below_after_night): how many values lie below 0 before and after the offset is taken off."""
    d = night_offset(df.withColumn("_night", F.coalesce(night, F.lit(False))), keys, F.col("_night"), ts, v)
    free = F.col(v) - F.col("offset")
    below = lambda x, only: F.count_if((x < 0) & only)
    every, dark = F.lit(True), F.col("_night")
    return d.groupBy(*keys).agg(F.count_if(dark).alias("n_night"), below(F.col(v), every).alias("below_before"), below(F.col(v), dark).alias("below_before_night"), below(free, every).alias("below_after"), below(free, dark).alias("below_after_night"))
