"""Detectors and raw tests in a row: each works on what the ones before have left, and their flags make one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.functions import names
from aeolith.operators import outliers, quality


def lof_flag(df: DataFrame, keys: list[str], k: int = 20, contamination: float | None = None, v: str = "v", name: str = "flag") -> DataFrame:
    """2 where the local outlier factor is above 1.5, or among the given share of the largest; k is at most one less than the values."""
    d = outliers.lof(df, keys, k, v)
    if contamination is None:
        bad = F.col("lof") > 1.5
    else:
        bad = F.percent_rank().over(Window.partitionBy(*keys).orderBy("lof")) > 1 - contamination
    d = d.withColumn(name, F.when(bad, 2).otherwise(0)).drop("lof")
    return d.unionByName(df.where(F.col(v).isNull()).withColumn(name, F.lit(None).cast("int")))


def suggest_neighbours(n: int) -> int:
    """Neighbours for so many values."""
    return max(1, min(20, n - 1))


def by_day_and_night(df: DataFrame, day: str, test: Callable[[DataFrame, str], DataFrame], day_test: Callable[[DataFrame, str], DataFrame] | None = None, name: str = "flag") -> DataFrame:
    """test on daytime and on night-time values apart; rows that are neither get null."""
    parts = [(day_test or test)(df.where(F.col(day) == 1), name), test(df.where(F.col(day) == 0), name), df.where(F.col(day).isNull()).withColumn(name, F.lit(None).cast("int"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@dataclass(frozen=True)
class Screening:
    """A series under test: df has v as it was, ``left`` as the tests have left it, and a flag column for each test that was kept.

    try_() runs a detector, given as (df, column, flag name) to df with the flag; keep() adopts its flag, under a name
    with _2, _3 … if it was run before. What isn't kept changes nothing.
    """

    df: DataFrame
    keys: list[str]
    v: str
    flags: tuple[str, ...] = ()
    pending: DataFrame | None = None
    pending_name: str = ""
    ts: str = "ts"

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], v: str, ts: str = "ts") -> Screening:
        return cls(df.withColumn("left", F.col(v)), keys, v, ts=ts)

    def try_(self, name: str, test: Callable[[DataFrame, str, str], DataFrame], repeat: bool = False) -> Screening:
        d = outliers.repeated(self.df, lambda x, c: test(x, c, "_t"), "left", "_flag") if repeat else test(self.df, "left", "_flag")
        return replace(self, pending=d, pending_name=f"FLAG_{self.v}_OUTLIER_{name}_TEST")

    def keep(self) -> Screening:
        if self.pending is None:
            raise ValueError("no test was run")
        name, n = self.pending_name, 1
        while name in self.flags:
            n += 1
            name = self.pending_name.replace("_TEST", f"_{n}_TEST")
        d = self.pending.withColumnRenamed("_flag", name).withColumn("left", F.when(F.coalesce(F.col(name) != 2, F.lit(True)), F.col("left")))
        return replace(self, df=d, flags=(*self.flags, name), pending=None, pending_name="")

    def overall(self, day: Column | None = None, day_from: int = 2, night_from: int = 2) -> DataFrame:
        """df with qcf of all flags kept, and the values that it leaves as filtered."""
        q = quality.overall([F.col(f"`{f}`") for f in self.flags], day, day_from, night_from) if self.flags else F.lit(0)
        return self.df.withColumn("qcf", q).withColumn("filtered", F.when(F.col("qcf") < 2, F.col(self.v)))

    def report(self) -> DataFrame:
        return quality.screening_report(self.df, self.v, list(self.flags), self.keys)


def steady_state_flag(code: Column, ts: Column | None = None, ranges: list | None = None, value: int = 2) -> Column:
    """The test's 0, 1 or 2 as it is; inside ranges of time value instead."""
    f = F.when(code.isin(0, 1, 2), code.cast("int"))
    for a, z in ranges or []:
        f = F.when(ts.between(F.lit(a).cast("timestamp_ntz"), F.lit(z).cast("timestamp_ntz")), value).otherwise(f)
    return f


def flux_flags(df: DataFrame, flux: str, tests: set[str] | None = None, signal: str | None = None, signal_threshold: float = 85.0) -> DataFrame:
    """df with FLAG_* columns of the raw tests of a flux, of those whose inputs it has, and qcf over them."""
    base = names.base_variable(flux)
    inputs = names.raw_test_inputs(flux, base)
    wanted = {t for t in (tests if tests is not None else set(inputs)) if inputs[t] and all(c in df.columns for c in inputs[t])}
    new: dict[str, Column] = {f"FLAG_L2_{flux}_MISSING_TEST": outliers.missing_values(flux)}
    if "ssitc" in wanted:
        new[f"FLAG_L2_{flux}_SSITC_TEST"] = steady_state_flag(F.col(inputs["ssitc"][0]))
    if "gas_completeness" in wanted:
        new[f"FLAG_L2_{flux}_COMPLETENESS_TEST"] = quality.completeness_flag(F.col(f"{base}_NR"), F.col("EXPECT_NR"))
    if "spectral_correction_factor" in wanted:
        new[f"FLAG_L2_{flux}_SCF_TEST"] = quality.threshold_flag(F.col(inputs["spectral_correction_factor"][0]), 2.0, 4.0)
    if "raw_data_screening_vm97" in wanted:
        new |= {f"FLAG_L2_{flux}_VM97_{t.upper()}_TEST": c for t, c in quality.raw_data_flags(F.col(inputs["raw_data_screening_vm97"][0])).items()}
    if "angle_of_attack" in wanted:
        new[f"FLAG_L2_{flux}_AOA_TEST"] = quality.second_digit_flag(F.col("VM97_AOA_HF"))
    if "steadiness_of_horizontal_wind" in wanted:
        new[f"FLAG_L2_{flux}_NSHW_TEST"] = quality.second_digit_flag(F.col("VM97_NSHW_HF"))
    if signal:
        new[f"FLAG_L2_{flux}_SIGNAL_TEST"] = quality.signal_strength_flag(F.col(signal), signal_threshold)
    d = df.withColumns(new)
    return d.withColumn(f"FLAG_L2_{flux}_QCF", quality.overall([F.col(c) for c in new]))


def harmonised(df: DataFrame, keys: list[str], least_share: float = 0.002, ts: str = "ts") -> DataFrame:
    """Records of several time resolutions at the finest one: coarser values, whose stamp ends their interval, stand at each finer stamp within it. Resolutions with a smaller share of records than least_share are left out.

    A record's resolution is its distance from the one before, or that of the next where it is the first.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    step = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    d = df.withColumn("_s", F.coalesce(step, F.timestamp_diff("SECOND", F.col(ts), F.lead(ts).over(w))))
    n = d.groupBy(*keys, "_s").agg(F.count("*").alias("_n")).withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))).where(F.col("_share") > least_share)
    n = n.withColumn("_f", F.min("_s").over(Window.partitionBy(*keys)))
    d = d.join(n.select(*keys, "_s", "_f"), [*keys, "_s"])
    back = F.transform(F.sequence(F.lit(0), (F.col("_s") / F.col("_f")).cast("int") - 1), lambda i: i * F.col("_f"))
    d = d.withColumn("_back", F.explode(back)).withColumn(ts, (F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_back"))).cast("timestamp_ntz"))
    first = Window.partitionBy(*keys, ts).orderBy("_s")
    return d.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*df.columns)


def highest_quality(df: DataFrame, keys: list[str], day: str, size: int | None = None, day_sigmas: float = 5.5, night_sigmas: float = 5.5, v: str = "v", ts: str = "ts") -> DataFrame:
    """df with flag, filtered, median and sd: outliers by day and by night, then running medians and deviations of what is left of each.

    The window is a hundredth of the values, 13 at least; running medians take a tenth of what is left of a time of day.
    """
    n = size or max(int((df.where(F.col(v).isNotNull()).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) / 100), 13)
    at = lambda s: lambda d, name: outliers.hampel(d, keys, n, s, ts, v, name, differences=True)
    d = by_day_and_night(df, day, at(night_sigmas), at(day_sigmas)).withColumn("filtered", F.when(F.col("flag") == 0, F.col(v)))
    part = Window.partitionBy(*keys, day)
    counts = d.where("filtered IS NOT NULL").groupBy(*keys, day).count().agg(F.max("count")).first()[0] or 0
    half = max(int(counts / 10), 1) // 2
    running = part.orderBy(ts).rowsBetween(-half, half)
    return d.withColumn("median", F.percentile("filtered", F.lit(0.5)).over(running)).withColumn("sd", F.stddev_samp("filtered").over(part))


def checked_units(df: DataFrame, keys: list[str], units: str = "units") -> DataFrame:
    """df, if each series has one unit; else ValueError."""
    bad = df.groupBy(*keys).agg(F.count_distinct(units).alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"several units in {[tuple(r)[:-1] for r in bad]}")
    return df


def finished(s: Screening, seconds: int, agg: str = "avg", least_share: float = 0.25, tags: dict[str, str] | None = None, day: Column | None = None, day_from: int = 2, night_from: int = 2) -> DataFrame:
    """(keys, ts, v, tags…): what all kept tests leave, by time bucket, with tags as columns. Fields of one table are series: the field's name is a key."""
    from aeolith.operators.resample import resample

    left = s.overall(day, day_from, night_from).select(*s.keys, s.ts, F.col("filtered").alias("v"))
    return resample(left, s.keys, seconds, agg, least_share, ts=s.ts).withColumns({k: F.lit(v) for k, v in (tags or {}).items()})


def radiation_days(df: DataFrame, keys: list[str], lat: float, lon: float, utc_offset: float, v: str = "v", ts: str = "ts") -> DataFrame:
    """(keys, day, n, r): correlation of each day's values with potential radiation; low ones point at wrong clocks."""
    from aeolith.functions import solar
    from aeolith.operators.stats import daily_correlation

    p = solar.potential_radiation(F.dayofyear(ts), F.hour(ts) + F.minute(ts) / 60, lat, lon, utc_offset)
    return daily_correlation(df.withColumn("_pot", p), keys, v, "_pot", ts)
