"""Self-heating of open-path analysers: surface temperatures, the unscaled correction, scaling factors by class, and their use."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Published regressions (slope, offset by day and by night) of surface on air temperature.
JAR09 = {"day": (0.93, 3.17), "night": (1.05, 1.52)}
BUR08 = {"top": {"day": (1.005, 0.24), "night": (1.008, -0.41)}, "bottom": {"day": (0.944, 2.57), "night": (0.883, 2.17)}, "spar": {"day": (1.01, 0.36), "night": (1.01, -0.17)}}
#: Quadratic regression of surface on air temperature, from the square down.
BUR06 = (0.0025, 0.9, 2.07)
#: Sizes in metres (length of the boundary layer, radius) of the analyser's parts; share of the spar's heat; ratio of molar masses.
LENGTH, RADIUS, SPAR_SHARE, DILUTION = {"top": 0.045, "bottom": 0.065, "spar": 0.005}, {"top": 0.0225, "spar": 0.0025}, 0.15, 1.6077
KELVIN = 273.15


def _by_day(day: Column, lines: dict[str, tuple[float, float]], ta: Column) -> Column:
    line = lambda k: lines[k][0] * ta + lines[k][1]
    return F.when(day == 1, line("day")).when(day == 0, line("night"))


def conductivity(ta: Column) -> Column:
    """Thermal conductivity of air in W/m/K."""
    return 0.02425 + 0.00007 * ta


def surface_temperature(model: str, ta: Column, day: Column) -> Column:
    """Surface temperature by JAR09 (by day and night) or BUR06 (quadratic)."""
    return _by_day(day, JAR09, ta) if model == "JAR09" else BUR06[0] * ta * ta + BUR06[1] * ta + BUR06[2]


def surface_heat(ta: Column, u: Column, day: Column) -> Column:
    """Sensible heat from top, bottom and spar of the analyser in W/m2 (BUR08)."""
    k, warmer = conductivity(ta), {p: _by_day(day, BUR08[p], ta) - ta for p in BUR08}
    layer = {"top": 0.0028 * F.sqrt(LENGTH["top"] / u) + 0.00025 / u + 0.0045, "bottom": 0.004 * F.sqrt(LENGTH["bottom"] / u) + 0.004, "spar": 0.0058 * F.sqrt(LENGTH["spar"] / u)}
    top = k * (RADIUS["top"] + layer["top"]) * warmer["top"] / (RADIUS["top"] * layer["top"])
    spar = k * warmer["spar"] / (RADIUS["spar"] * F.log((RADIUS["spar"] + layer["spar"]) / RADIUS["spar"]))
    return k * warmer["bottom"] / layer["bottom"] + top + SPAR_SHARE * spar


def unscaled_correction(model: str = "JAR09") -> Column:
    """The correction before scaling, in the units of gas, from columns ta (deg C), gas (per m3), rho_a, rho_v, rho_d, c_p, u, ra, daytime."""
    ta = F.col("ta")
    wet = 1 + DILUTION * F.col("rho_v") / F.col("rho_d")
    if model == "BUR08":
        return surface_heat(ta, F.col("u"), F.col("daytime")) / (F.col("rho_a") * F.col("c_p")) * F.col("gas") / (ta + KELVIN) * wet
    return (surface_temperature(model, ta, F.col("daytime")) - ta) * F.col("gas") / (F.col("ra") * (ta + KELVIN)) * wet


def without_outliers(df: DataFrame, keys: list[str], column: str, size: int = 1440, sigmas: float = 5.0, ts: str = "ts") -> DataFrame:
    """column without values further from the centred running median than sigmas times the scaled running median of such distances."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(size // 2), (size - 1) // 2)
    d = df.withColumn("_apart", F.abs(F.col(column) - F.percentile(column, F.lit(0.5)).over(w)))
    limit = 1.4826 * sigmas * F.percentile("_apart", F.lit(0.5)).over(w)
    return d.withColumn("_limit", limit).withColumn(column, F.when(~F.coalesce(F.col("_apart") > F.col("_limit"), F.lit(False)), F.col(column))).drop("_apart", "_limit")


def best_factor(correction: np.ndarray, flux: np.ndarray, reference: np.ndarray, low: float = 0.0, high: float = 50.0) -> tuple[float, float]:
    """(factor, cost): the least sum of distances between the running sums of flux + factor * correction and of the reference.

    The cost is a sum of absolute values of lines in the factor, so its least is the weighted median of their zeros.
    """
    c, d = np.cumsum(correction), np.cumsum(reference - flux)
    with np.errstate(divide="ignore", invalid="ignore"):
        zero = np.where(c != 0, d / c, low)
    order = np.argsort(zero, kind="stable")
    weight = np.abs(c)[order].cumsum()
    at = min(int(np.searchsorted(weight, weight[-1] / 2)), len(order) - 1)
    factor = float(np.clip(zero[order][at], low, high))
    return factor, float(np.abs(factor * c - d).sum())


def scaling_factors(df: DataFrame, keys: list[str], classes: int = 20, draws: int = 0, block: int = 12, least: int = 50, seed: int = 42, ts: str = "ts") -> DataFrame:
    """df (class_var, daytime, correction, flux, reference) to (keys, daytime, class, low, high, factor, q25, q75, cost, n).

    Classes are quantiles of class_var by day and by night; classes of fewer complete records than least have no factor.
    draws resample blocks of consecutive records. A series, time of day and class is a task.
    """
    d = df.where("class_var IS NOT NULL AND daytime IS NOT NULL")
    edges = d.groupBy(*keys, "daytime").agg(F.percentile("class_var", F.array(*[F.lit(i / classes) for i in range(1, classes)])).alias("_edges"))
    d = d.join(edges, [*keys, "daytime"]).withColumn("class", F.size(F.filter("_edges", lambda e: e < F.col("class_var"))))
    d = d.where("correction IS NOT NULL AND flux IS NOT NULL AND reference IS NOT NULL").select(*keys, "daytime", "class", ts, "class_var", "correction", "flux", "reference")
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "daytime", "class"))).where(F.col("_n") >= least).drop("_n")
    names = [*keys, "daytime", "class", "low", "high", "factor", "q25", "q75", "cost", "n"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x = pdf[["correction", "flux", "reference"]].to_numpy(float).T
        rng = np.random.default_rng([seed, int(pdf["class"].iloc[0]), int(pdf["daytime"].iloc[0])])
        found = []
        for _ in range(max(draws, 1)):
            at = ((rng.integers(0, len(pdf), -(-len(pdf) // block))[:, None] + np.arange(block)).reshape(-1) % len(pdf))[: len(pdf)] if draws else slice(None)
            found.append(best_factor(*x[:, at]))
        f, cost = np.array(found).T
        row = [*[pdf[k].iloc[0] for k in (*keys, "daytime", "class")], pdf["class_var"].min(), pdf["class_var"].max(), np.median(f), *np.quantile(f, [0.25, 0.75]), np.median(cost), len(pdf)]
        return pd.DataFrame([row], columns=names)

    types = dict(d.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "daytime", "class")) + ", low double, high double, factor double, q25 double, q75 double, cost double, n long"
    return d.groupBy(*keys, "daytime", "class").applyInPandas(run, schema)


def apply_scaling(df: DataFrame, factors: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """df (class_var, daytime, correction, flux) with class, factor, corrected and corrected_flag.

    A record takes the class with the largest lower edge not above its class_var, or the lowest class; one without a
    class_var takes the median factor of its month, time of day, hour and minute, else of month and day or night. A
    flux without a correction stays as it is, with flag 0.
    """
    edges = factors.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("daytime").alias("_day")).agg(F.array_sort(F.collect_list(F.struct("low", "class", "factor"))).alias("_f"))
    same = F.col("daytime") == F.col("_day")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = df.join(F.broadcast(edges), same, "left").drop("_day", *[f"_{k}" for k in keys])
    below = F.filter("_f", lambda x: x["low"] <= F.col("class_var"))
    own = F.when(F.col("class_var").isNotNull() & F.col("_f").isNotNull(), F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.element_at("_f", 1)))
    d = d.withColumn("_own", own).withColumn("class", F.col("_own.class")).withColumn("factor", F.col("_own.factor"))
    month = [*keys, F.month(ts), F.col("daytime")]
    fine, coarse = Window.partitionBy(*month, F.hour(ts), F.minute(ts)), Window.partitionBy(*month)
    d = d.withColumn("_1", F.percentile("factor", F.lit(0.5)).over(fine)).withColumn("_2", F.percentile(F.coalesce("factor", "_1"), F.lit(0.5)).over(coarse))
    d = d.withColumn("factor", F.coalesce("factor", "_1", "_2")).drop("_own", "_f", "_1", "_2")
    d = d.withColumn("_c", F.col("correction") * F.col("factor"))
    return d.withColumn("corrected", F.col("flux") + F.coalesce("_c", F.lit(0.0))).withColumn("corrected_flag", F.when(F.col("flux").isNotNull(), F.col("_c").isNotNull().cast("int"))).drop("_c")
