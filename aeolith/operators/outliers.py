"""Outlier flags: 0 passes, 2 is rejected, null where the value is missing or can't be tested."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.sources.files import checkpoint_folder

K_MAD = 1.4826


def flag(value: Column, rejected: Column) -> Column:
    return F.when(value.isNull(), None).when(rejected, 2).otherwise(0)


def missing_values(v: str = "v") -> Column:
    return F.when(F.col(v).isNull(), 2).otherwise(0)


def absolute_limits(v: str, lo: float, hi: float) -> Column:
    return flag(F.col(v), ~F.col(v).between(lo, hi))


def absolute_limits_by(v: str, day: Column, day_limits: tuple, night_limits: tuple) -> Column:
    """Limits of their own by day and by night; null where it is neither."""
    bad = F.when(day, ~F.col(v).between(*day_limits)).otherwise(~F.col(v).between(*night_limits))
    return F.when(day.isNotNull(), flag(F.col(v), bad))


def zscore(df: DataFrame, keys: list[str], threshold: float = 4.0, v: str = "v", name: str = "flag") -> DataFrame:
    """Distance from the series' mean in population standard deviations."""
    w = Window.partitionBy(*keys)
    z = F.try_divide(F.abs(F.col(v) - F.avg(v).over(w)), F.stddev_pop(v).over(w))
    return df.withColumn(name, flag(F.col(v), z > threshold))


def _centred(keys: list[str], ts: str, size: int):
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(size // 2), (size - 1) // 2)


def _on_values(df: DataFrame, keys: list[str], ts: str, v: str, test: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """test() over rows with a value only, as windows count values and not slots; rows without get null."""
    tested = test(df.where(F.col(v).isNotNull()))
    return tested.unionByName(df.where(F.col(v).isNull()).withColumn(name, F.lit(None).cast("int")), allowMissingColumns=True).select(*df.columns, name)


def zscore_rolling(df: DataFrame, keys: list[str], size: int, threshold: float = 4.0, ts: str = "ts", v: str = "v", name: str = "flag") -> DataFrame:
    """Distance from the centred rolling mean in rolling sample standard deviations, of three values at least."""

    def test(d: DataFrame) -> DataFrame:
        w = _centred(keys, ts, size)
        z = F.when(F.count(v).over(w) >= 3, F.try_divide(F.abs(F.col(v) - F.avg(v).over(w)), F.stddev_samp(v).over(w)))
        return d.withColumn(name, F.when(z > threshold, 2).when(z <= threshold, 0))

    return _on_values(df, keys, ts, v, test, name)


def zscore_increments(df: DataFrame, keys: list[str], threshold: float = 4.0, ts: str = "ts", v: str = "v", name: str = "flag") -> DataFrame:
    """Rejects where the steps from the value before, to the one after and their sum all stand out by z-score."""

    def test(d: DataFrame) -> DataFrame:
        w, every = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys)
        d = d.withColumn("_a", F.abs(F.col(v) - F.lag(v).over(w))).withColumn("_b", F.abs(F.col(v) - F.lead(v).over(w)))
        d = d.withColumn("_c", F.col("_a") + F.col("_b"))
        z = lambda c: F.coalesce(F.try_divide(F.abs(F.col(c) - F.avg(c).over(every)), F.stddev_pop(c).over(every)) > threshold, F.lit(False))
        return d.withColumn(name, F.when(z("_a") & z("_b") & z("_c"), 2).otherwise(0)).drop("_a", "_b", "_c")

    return _on_values(df, keys, ts, v, test, name)


def hampel(df: DataFrame, keys: list[str], size: int, sigmas: float = 5.5, ts: str = "ts", v: str = "v", name: str = "flag", differences: bool = False) -> DataFrame:
    """Distance from the centred rolling median beyond sigmas scaled rolling median absolute deviations, each taken against its own row's median; none where that deviation is 0.

    With differences the test is on 2x - previous - next, and rows beside the ends of the values can't be tested.
    """

    def test(d: DataFrame) -> DataFrame:
        w, o = _centred(keys, ts, size), Window.partitionBy(*keys).orderBy(ts)
        x = 2 * F.col(v) - F.lag(v).over(o) - F.lead(v).over(o) if differences else F.col(v)
        d = d.withColumn("_x", x).withColumn("_m", F.percentile("_x", F.lit(0.5)).over(w)).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
        d = d.withColumn("_s", F.percentile("_d", F.lit(0.5)).over(w) * K_MAD)
        bad = (F.col("_s") > 0) & (F.col("_d") > sigmas * F.col("_s"))
        return d.withColumn(name, F.when(F.col("_x").isNull(), None).when(bad, 2).otherwise(0)).drop("_x", "_m", "_d", "_s")

    return _on_values(df, keys, ts, v, test, name)


def local_sd(df: DataFrame, keys: list[str], size: int, n_sd: float = 7.0, constant: bool = False, ts: str = "ts", v: str = "v", name: str = "flag") -> DataFrame:
    """Distance from the centred rolling median beyond n_sd sample standard deviations, rolling or of the whole series."""

    def test(d: DataFrame) -> DataFrame:
        w = _centred(keys, ts, size)
        enough = F.count(v).over(w) >= 3
        sd = F.stddev_samp(v).over(Window.partitionBy(*keys)) if constant else F.stddev_samp(v).over(w)
        far = F.abs(F.col(v) - F.percentile(v, F.lit(0.5)).over(w)) > n_sd * sd
        return d.withColumn(name, F.when(~enough, None).when(far, 2).otherwise(0))

    return _on_values(df, keys, ts, v, test, name)


def trim_low(df: DataFrame, keys: list[str], limit: float, v: str = "v", name: str = "flag") -> DataFrame:
    """Values below the limit, and as many of the highest."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(v).desc_nulls_last(), "ts"))
    low = F.count_if(F.col(v) < limit).over(w)
    return df.withColumn(name, flag(F.col(v), (F.col(v) < limit) | (rank <= low)))


def manual_removal(v: str, ts: str, ranges: list) -> Column:
    """Rejects rows at stamps and within (start, end); a bare date is its whole day."""
    bad = F.lit(False)
    for r in ranges:
        a, z = r if isinstance(r, (tuple, list)) else (r, r)
        last = F.lit(z).cast("timestamp_ntz") + F.expr("INTERVAL '86399.999999' SECOND" if len(str(z)) <= 10 else "INTERVAL '0' SECOND")
        bad = bad | F.col(ts).between(F.lit(a).cast("timestamp_ntz"), last)
    return flag(F.col(v), bad)


def repeated(df: DataFrame, test: Callable[[DataFrame, str], DataFrame], v: str = "v", name: str = "flag") -> DataFrame:
    """test(df, column) again and again on what passed, until it rejects no more; each round is checkpointed, so lineage stays short and lost executors don't start over."""
    checkpoint_folder(df.sparkSession)
    d = df.withColumn("_left", F.col(v)).withColumn(name, F.when(F.col(v).isNotNull(), 0))
    while True:
        d = test(d, "_left").withColumn("_bad", F.coalesce(F.col("_t") == 2, F.lit(False)))
        d = d.withColumn(name, F.when(F.col("_bad"), 2).otherwise(F.col(name))).withColumn("_left", F.when(~F.col("_bad"), F.col("_left"))).checkpoint()
        if d.where("_bad").isEmpty():
            break
        d = d.drop("_bad", "_t")
    return d.drop("_bad", "_t", "_left")


def lof(df: DataFrame, keys: list[str], k: int = 20, v: str = "v") -> DataFrame:
    """Local outlier factor of values on their line. The k nearest are among the k before and k after in order of value, so ranked windows suffice: no pairs."""
    d = df.where(F.col(v).isNotNull())
    w = Window.partitionBy(*keys).orderBy(v, "ts")
    near = lambda c: F.collect_list(c).over(w.rowsBetween(-k, k))
    d = d.withColumn("_near", near(v)).withColumn("_dist", F.array_sort(F.transform("_near", lambda x: F.abs(x - F.col(v)))))
    d = d.withColumn("_k", F.element_at("_dist", F.least(F.lit(k + 1), F.size("_dist"))))  # the first is the point itself
    d = d.withColumn("_pairs", F.collect_list(F.struct(F.col(v).alias("x"), F.col("_k").alias("k"))).over(w.rowsBetween(-k, k)))
    reach = F.transform(F.slice(F.array_sort(F.transform("_pairs", lambda p: F.struct(F.abs(p["x"] - F.col(v)).alias("d"), p["k"].alias("k")))), 2, k), lambda p: F.greatest(p["d"], p["k"]))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))
    d = d.withColumn("_lrd", 1 / (mean(reach) + F.lit(1e-10)))
    d = d.withColumn("_pairs", F.collect_list(F.struct(F.col(v).alias("x"), F.col("_lrd").alias("l"))).over(w.rowsBetween(-k, k)))
    others = F.transform(F.slice(F.array_sort(F.transform("_pairs", lambda p: F.struct(F.abs(p["x"] - F.col(v)).alias("d"), p["l"].alias("l")))), 2, k), lambda p: p["l"])
    return d.withColumn("lof", mean(others) / F.col("_lrd")).drop("_near", "_dist", "_k", "_pairs", "_lrd")
