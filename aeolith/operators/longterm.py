"""Models of many years: each year has its own, learned from a pool of that year and its neighbours; selection of features, search of parameters, filling of radiation."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators import drivers

#: What the flags of filled radiation mean.
RADIATION_FLAGS = {0: "measured", 1: "model", 2: "fallback model", 3: "night", 4: "interpolated"}


@dataclass(frozen=True)
class Filled:
    """df with filled and fill_flag; scores by year; importances by year; which years each year's model has learned from."""

    df: DataFrame
    scores: dict[int, dict[str, float]]
    importances: DataFrame | None
    pools: dict[int, list[int]]
    features: list[str]


def pools(years: list[int]) -> dict[int, list[int]]:
    """The years a year's model learns from: itself, the one before and the one after; at the ends the next two."""
    years = sorted(years)
    out = {}
    for i, y in enumerate(years):
        lo = min(max(i - 1, 0), max(len(years) - 3, 0))
        out[y] = years[lo : lo + 3]
    return out


def select_features(df: DataFrame, target: str, names: list[str], factor: float = 0.5, kind: str = "rf", seed: int = 42, ts: str = "ts") -> tuple[list[str], DataFrame]:
    """(features kept, table): those whose importance is above that of a random one by factor standard deviations of all importances, and above 0."""
    a = drivers.Drivers(df, target, names, ts, kind, seed=seed)
    d = a._known().withColumn("_random", F.pmod(F.xxhash64(ts, F.lit(seed)), F.lit(1_000_003)) / 1_000_003)
    every = [*names, "_random"]
    t = a.importance(d, drivers._model(kind, seed).fit(drivers._vector(d, every)), every).cache()
    noise, sd = t.where("driver = '_random'").first()["importance"], t.agg(F.stddev_pop("importance")).first()[0] or 0.0
    kept = {r.driver for r in t.where((F.col("importance") > noise + factor * sd) & (F.col("importance") > 0)).collect()}
    return [n for n in names if n in kept], t


def fill_yearly(df: DataFrame, target: str, names: list[str], kind: str = "rf", reduce: bool = False, factor: float = 0.5, below_zero: float | None = None, test_share: float = 0.25, seed: int = 42, ts: str = "ts", importances: bool = False) -> Filled:
    """Gaps of target by models of each year's pool, of which only the year itself is kept; flag 0 measured, 1 model, 2 the calendar's where a feature is missing.

    With reduce the features kept in any year serve in all. below_zero is what predictions below 0 become. Years are
    fitted one after the other, each by the whole cluster. One series; keys are the caller's loop.
    """
    d = df.withColumn("_year", F.year(ts)).withColumn("_cs", F.sin(F.dayofyear(ts) * 2 * math.pi / 365.25)).withColumn("_cc", F.cos(F.dayofyear(ts) * 2 * math.pi / 365.25))
    d = d.withColumn("_hs", F.sin(F.hour(ts) * math.pi / 12)).withColumn("_hc", F.cos(F.hour(ts) * math.pi / 12)).withColumn("_y", F.col(target).cast("double"))
    clock = ["_cs", "_cc", "_hs", "_hc"]
    pool = pools([r[0] for r in d.select("_year").distinct().collect()])
    if reduce:
        kept: set[str] = set()
        for years in pool.values():
            own = d.where(F.col("_year").isin(years))
            if not own.dropna(subset=["_y", *names]).isEmpty():
                kept |= set(select_features(own, target, names, factor, kind, seed, ts)[0])
        names = [n for n in names if n in kept] or names
    whole = _all(names)
    parts, scores, tables = [], {}, []
    for year, years in pool.items():
        known = d.where(F.col("_year").isin(years) & F.col("_y").isNotNull())
        full = known.where(whole)
        own = d.where(F.col("_year") == year)
        if known.isEmpty():
            parts.append(own.withColumn("_p", F.lit(None).cast("double")).withColumn("_flag", F.lit(None).cast("int")))
            continue
        second = drivers._model(kind, seed).fit(drivers._vector(known, clock))
        rest = second.transform(drivers._vector(own.where(~whole), clock)).withColumn("_flag", F.lit(2))
        if full.isEmpty():
            rest = second.transform(drivers._vector(own, clock)).withColumn("_flag", F.lit(2))
            parts.append(rest.drop("_x"))
            continue
        train = F.pmod(F.xxhash64(ts, F.lit(seed)), F.lit(1000)) >= int(test_share * 1000)
        first = drivers._model(kind, seed).fit(drivers._vector(full.where(train) if not full.where(train).isEmpty() else full, names))
        e = first.transform(drivers._vector(full.where(~train), names)).agg(F.avg((F.col("_p") - F.col("_y")) ** 2).alias("m"), F.var_pop("_y").alias("v"), F.count("*").alias("n")).first()
        scores[year] = {"rmse": math.sqrt(e.m), "r2": 1 - e.m / e.v if e.v else 0.0, "n_test": e.n, "n_train": full.count() - e.n} if e.n else {}
        if importances:
            tables.append(drivers.Drivers(df, target, names, ts, kind, seed=seed).importance(full, first).withColumn("year", F.lit(year)))
        parts.append(first.transform(drivers._vector(own.where(whole), names)).withColumn("_flag", F.lit(1)).unionByName(rest).drop("_x"))
    every = _union(parts)
    p = F.when(F.col("_p") < 0, F.lit(below_zero)).otherwise(F.col("_p")) if below_zero is not None else F.col("_p")
    out = every.withColumn("filled", F.coalesce("_y", p)).withColumn("fill_flag", F.when(F.col("_y").isNotNull(), 0).otherwise(F.col("_flag")))
    return Filled(out.select(*df.columns, "filled", "fill_flag"), scores, _union(tables) if tables else None, pool, names)


def _all(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(True))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quick_fill(df: DataFrame, keys: list[str], target: str, names: list[str], ts: str = "ts") -> Filled:
    """A first look: the drivers and their values before, small models."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = {f"{c}-1": F.lag(f"`{c}`").over(w) for c in names}
    return fill_yearly(df.withColumns(new), target, [*names, *new], ts=ts)


def search(df: DataFrame, target: str, names: list[str], grid: dict[str, list], kind: str = "rf", folds: int = 10, seed: int = 42, ts: str = "ts") -> DataFrame:
    """(parameters…, mse, rank): each combination's mean squared error over folds of the first three quarters of a record, each fold learned from all that lies before it."""
    d = df.dropna(subset=[target, *names]).withColumn("_y", F.col(target).cast("double")).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    edges = d.agg(F.percentile("_t", F.array(*[F.lit(0.75 * i / (folds + 1)) for i in range(folds + 2)]))).first()[0]
    rows = []
    for values in itertools.product(*grid.values()):
        errors = []
        for k in range(1, folds + 1):
            train, test = d.where(F.col("_t") <= edges[k]), d.where((F.col("_t") > edges[k]) & (F.col("_t") <= edges[k + 1]))
            model = drivers._model(kind, seed).setParams(**dict(zip(grid, values, strict=True))).fit(drivers._vector(train, names))
            e = model.transform(drivers._vector(test, names)).agg(F.avg((F.col("_p") - F.col("_y")) ** 2)).first()[0]
            if e is not None:
                errors.append(e)
        rows.append((*map(str, values), sum(errors) / len(errors) if errors else None))
    t = df.sparkSession.createDataFrame(rows, ", ".join(f"`{k}` string" for k in grid) + ", mse double")
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mse").asc_nulls_last(), *grid)))


def fill_radiation(df: DataFrame, keys: list[str], potential: str = "potential", short: int = 3, night_below: float = 0.001, bright: float = 50.0, v: str = "v", ts: str = "ts", names: list[str] | None = None) -> DataFrame:
    """df with filled and fill_flag (RADIATION_FLAGS) of incoming short-wave radiation.

    Nights are 0. Gaps of up to short records within a day, with potential radiation of bright or more on both sides,
    take the share of potential radiation between their neighbours' shares. Others take a model of potential radiation,
    time of day and names, learned from daytime records, and where names are missing one without them.
    """
    day = F.col(potential) >= night_below
    w = Window.partitionBy(*keys).orderBy(ts)
    share = F.when(F.col(v).isNotNull() & (F.col(potential) >= bright), F.col(v) / F.col(potential))
    d = df.withColumn("_s", share).withColumn("_n", F.row_number().over(w))
    side = lambda c, back: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first(c, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    known = F.when(F.col(v).isNotNull(), F.struct("_n", "_s", F.to_date(ts).alias("d"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))
    d = d.withColumn("_k", known).withColumn("_a", side("_k", True)).withColumn("_z", side("_k", False)).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    close = (F.col("_z._n") - F.col("_a._n") - 1 <= short) & (F.col("_a.d") == F.col("_z.d")) & F.col("_a._s").isNotNull() & F.col("_z._s").isNotNull()
    between = F.col("_a._s") + (F.col("_z._s") - F.col("_a._s")) * (F.col("_t") - F.col("_a.t")) / (F.col("_z.t") - F.col("_a.t"))
    d = d.withColumn("_i", F.when(F.col(v).isNull() & close & day, between * F.col(potential)))
    d = d.withColumn("_hour", F.hour(ts) + F.minute(ts) / 60.0).withColumn("_doy", F.dayofyear(ts).cast("double")).withColumn("_y", F.col(v).cast("double"))
    plain, rich = [potential, "_hour", "_doy"], [potential, "_hour", "_doy", *(names or [])]
    lit = d.where(day & F.col("_y").isNotNull())
    model = None if lit.isEmpty() else drivers._model("gbt", 42).fit(drivers._vector(lit, plain))
    if model is None:
        d = d.withColumn("_q", F.lit(None).cast("double")).withColumn("_r", F.lit(None).cast("double"))
    else:
        d = model.transform(drivers._vector(d.where(F.col(potential).isNotNull()), plain)).withColumnRenamed("_p", "_q").drop("_x").unionByName(d.where(F.col(potential).isNull()).withColumn("_q", F.lit(None).cast("double")))
        full = lit.where(_all(rich))
        if names and not full.isEmpty():
            better = drivers._model("gbt", 42).fit(drivers._vector(full, rich))
            d = better.transform(drivers._vector(d.where(_all(rich)), rich)).withColumnRenamed("_p", "_r").drop("_x").unionByName(d.where(~_all(rich)).withColumn("_r", F.lit(None).cast("double")))
        else:
            d = d.withColumn("_r", F.lit(None).cast("double") if names else F.col("_q"))
    flag = F.when(F.col("_y").isNotNull(), 0).when(~day, 3).when(F.col("_i").isNotNull(), 4).when(F.col("_r").isNotNull(), 1).when(F.col("_q").isNotNull(), 2)
    x = F.coalesce("_y", F.when(~day, F.lit(0.0)), "_i", F.greatest("_r", F.lit(0.0)), F.greatest("_q", F.lit(0.0)))
    return d.withColumn("fill_flag", flag).withColumn("filled", F.when(flag.isNotNull(), x)).select(*df.columns, "filled", "fill_flag")


def ranks_by_year(filled: Filled) -> DataFrame:
    """(driver, one column a year): the rank of each feature in each year's model."""
    if filled.importances is None:
        raise ValueError("importances were not asked for")
    return filled.importances.groupBy("driver").pivot("year", sorted(filled.pools)).agg(F.first("rank"))


def score_table(filled: Filled) -> DataFrame:
    """(year, pool, rmse, r2, n_train, n_test) of all models."""
    rows = [(y, filled.pools[y], s.get("rmse"), s.get("r2"), s.get("n_train"), s.get("n_test")) for y, s in sorted(filled.scores.items())]
    return filled.df.sparkSession.createDataFrame(rows, "year int, pool array<int>, rmse double, r2 double, n_train long, n_test long")
