"""Sequence features: neighbours, rolling statistics, differences, time since an event, calendar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolith.functions.meteo import cyclic, season


def lagged(df: DataFrame, keys: list[str], columns: list[str], lo: int, hi: int, step: int = 1, ts: str = "ts") -> DataFrame:
    """A column for each lag from lo to hi but 0; negative lags look back."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = {f"{c}_lag_{'m' if k < 0 else 'p'}{abs(k)}": (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) for c in columns for k in range(lo, hi + 1, step) if k}
    return df.withColumns(new)


def rolling(df: DataFrame, keys: list[str], column: str, sizes: list[int], ts: str = "ts") -> DataFrame:
    """Trailing mean, population SD, median, min, max, quartiles over the last records."""
    new = {}
    for n in sizes:
        w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), 0)
        new |= {f"mean_{n}": F.avg(column).over(w), f"sd_{n}": F.stddev_pop(column).over(w), f"median_{n}": F.percentile(column, F.lit(0.5)).over(w), f"min_{n}": F.min(column).over(w), f"max_{n}": F.max(column).over(w), f"q25_{n}": F.percentile(column, F.lit(0.25)).over(w), f"q75_{n}": F.percentile(column, F.lit(0.75)).over(w)}
    return df.withColumns(new)


def differences(df: DataFrame, keys: list[str], column: str, order: int = 1, ts: str = "ts") -> DataFrame:
    """Differences of the given order."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("diff", F.col(column))
    for _ in range(order):
        d = d.withColumn("diff", F.col("diff") - F.lag("diff").over(w))
    return d


def time_since(df: DataFrame, keys: list[str], column: str, lo: float | None = None, hi: float | None = None, inclusive: bool = True, ts: str = "ts") -> DataFrame:
    """Records since the value was last inside the limits, 0 inside; before the first time the count runs from the start. Nulls are outside."""
    x = F.col(column)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (x >= lo if inclusive else x > lo)
    if hi is not None:
        inside = inside & (x <= hi if inclusive else x < hi)
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("_in", F.coalesce(inside & x.isNotNull(), F.lit(False))).withColumn("_run", F.count_if("_in").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(ts))
    return d.withColumn("since", F.when(F.col("_run") == 0, r).otherwise(r - 1)).drop("_in", "_run")


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Year, season, month, week, day of year, hour, their cycles, and joined numbers."""
    t = F.col(ts)
    d = df.withColumns({"year": F.year(t), "season": season(F.month(t)), "month": F.month(t), "week": F.weekofyear(t), "doy": F.dayofyear(t), "hour": F.hour(t)})
    new = {}
    for c, period in (("season", 4), ("month", 12), ("week", 53), ("doy", 365.25), ("hour", 24)):
        new[f"{c}_sin"], new[f"{c}_cos"] = cyclic(F.col(c), period)
    return d.withColumns(new | {"yearmonth": F.col("year") * 100 + F.col("month"), "yeardoy": F.col("year") * 1000 + F.col("doy"), "yearweek": F.col("year") * 100 + F.col("week")})


def running_sum(df: DataFrame, keys: list[str], column: str, ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(column).over(w))


def record_numbers(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return df.withColumn("record", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)))
