"""Gap filling by marginal distribution sampling (Reichstein et al. 2005) and by tree models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.sources.files import checkpoint_folder
from aeolith.functions.meteo import swin_tolerance

#: The published cascade as (method, total days): 1 all drivers, 2 radiation, 3 mean diel course, the last with its tolerance in hours.
CASCADE = ((1, 14, 0), (1, 28, 0), (2, 14, 0), (3, 1, 1), (3, 3, 1), (3, 5, 1), *((1, d, 0) for d in range(42, 141, 14)), *((2, d, 0) for d in range(28, 141, 14)), *((3, d, 1) for d in range(7, 141, 14)))


def similar(method: int, ta_tolerance: float = 2.5, vpd_tolerance: float = 5.0) -> Column:
    """Of a gap g and a measured record m: are their conditions alike?"""
    sw = F.abs(F.col("g.swin") - F.col("m.swin")) <= swin_tolerance(F.col("g.swin"))
    if method == 1:
        return sw & (F.abs(F.col("g.ta") - F.col("m.ta")) <= ta_tolerance) & (F.abs(F.col("g.vpd") - F.col("m.vpd")) <= vpd_tolerance)
    if method == 2:
        return sw
    d = F.abs(F.col("g.hr") - F.col("m.hr"))
    return F.least(d, 24 - d) <= 1.0


def mds(df: DataFrame, keys: list[str], flux: str = "flux", ts: str = "ts", least: int = 2, cascade: tuple = CASCADE, ta_tolerance: float = 2.5, vpd_tolerance: float = 5.0) -> DataFrame:
    """df (keys, ts, flux, swin, ta, vpd) with filled, sd, n, method, window: the first step of the cascade with ``least`` similar records.

    Gaps and records meet by day: a gap is sent to the days within its step's window, and a record stays in its own, so
    the join is by equal day and its fan-out is fixed by the window. A step only sees gaps that earlier ones left.
    """
    days = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000)
    d = df.withColumn("_day", days).withColumn("hr", F.hour(ts) + F.minute(ts) / 60)
    checkpoint_folder(df.sparkSession)
    fresh = lambda x: x.select(*[F.col(c).alias(c) for c in x.columns])  # noqa: E731  columns of their own, as the frames meet in joins
    measured = d.where(F.col(flux).isNotNull()).select(*keys, "_day", F.col(ts).alias("mt"), F.col(flux).alias("x"), "swin", "ta", "vpd", "hr").checkpoint()
    measured = fresh(measured)
    left = fresh(d.where(F.col(flux).isNull()).select(*keys, ts, "_day", "swin", "ta", "vpd", "hr").checkpoint())
    found = []
    for method, window, _ in cascade:
        half = window // 2 + 1
        g = left.select(*keys, ts, "swin", "ta", "vpd", "hr", F.explode(F.sequence(F.col("_day") - half, F.col("_day") + half)).alias("_day")).alias("g")
        near = F.abs(F.timestamp_diff("SECOND", F.col(f"g.{ts}"), F.col("m.mt"))) <= window * 43200
        on = reduce(lambda a, b: a & b, [F.col(f"g.{k}") == F.col(f"m.{k}") for k in [*keys, "_day"]])
        got = g.join(measured.alias("m"), on & near & similar(method, ta_tolerance, vpd_tolerance))
        got = got.groupBy(*[F.col(f"g.{k}").alias(k) for k in keys], F.col(f"g.{ts}").alias(ts)).agg(F.avg("x").alias("filled"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))
        got = got.where(F.col("n") >= least).select("*", F.lit(method).alias("method"), F.lit(window).alias("window")).checkpoint()
        got = fresh(got)
        found.append(got)
        left = fresh(left.join(got.select(*keys, ts), [*keys, ts], "left_anti").checkpoint())
        if left.isEmpty():
            break
    return df.join(reduce(DataFrame.unionByName, found), [*keys, ts], "left").withColumn("filled", F.coalesce(F.col(flux), F.col("filled")))


def features(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> tuple[DataFrame, list[str]]:
    """Neighbours, rolling means and calendar columns for a model."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = {f"{c}_m1": F.lag(c).over(w) for c in columns} | {f"{c}_p1": F.lead(c).over(w) for c in columns} | {f"{c}_r6": F.avg(c).over(w.rowsBetween(-5, 0)) for c in columns}
    new |= {"doy_sin": F.sin(F.dayofyear(ts) * 2 * F.pi() / 365.25), "doy_cos": F.cos(F.dayofyear(ts) * 2 * F.pi() / 365.25), "hour_sin": F.sin(F.hour(ts) * 2 * F.pi() / 24), "hour_cos": F.cos(F.hour(ts) * 2 * F.pi() / 24)}
    return df.withColumns(new), [*columns, *new]


def by_trees(df: DataFrame, keys: list[str], target: str, drivers: list[str], model: str = "rf", share: float = 0.75, seed: int = 42, ts: str = "ts") -> tuple[DataFrame, dict[str, float]]:
    """(df with filled and fill_flag, scores on the held-out quarter of all series): 0 measured, 1 all features, 2 the calendar model where a driver is missing.

    Each series has models of its own, fitted one series after the other; gaps of one with nothing to learn from stay, with a null flag.
    The split is by hash of the row, so reruns agree. The second model learns from the series the first has filled.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    d, names = features(df, keys, drivers, ts)

    def fitted(rows: DataFrame, inputs: list[str], label: str, out: str):
        kind = RandomForestRegressor if model == "rf" else GBTRegressor
        options = {"numTrees": 30, "maxDepth": 8} if model == "rf" else {"maxIter": 30, "maxDepth": 5}
        return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol=f"{out}_x", handleInvalid="skip"), kind(featuresCol=f"{out}_x", labelCol=label, predictionCol=out, seed=seed, **options)]).fit(rows)

    part = F.pmod(F.xxhash64(*keys, ts, F.lit(seed)), F.lit(1000)) < int(share * 1000)
    clock = ["doy_sin", "doy_cos", "hour_sin", "hour_cos"]
    measured = F.when(F.col(target).isNotNull(), 0)

    def one(d: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        known = d.where(F.col(target).isNotNull())
        if known.where(part).dropna(subset=names).isEmpty():
            return d.withColumn("filled", F.col(target).cast("double")).withColumn("fill_flag", measured), None
        first = fitted(known.where(part), names, target, "_p")
        predicted = first.transform(d).select(*keys, ts, "_p")
        filled = d.join(predicted, [*keys, ts], "left").withColumn("_y", F.coalesce(F.col(target), F.col("_p")))
        filled = fitted(filled.where("_y IS NOT NULL"), clock, "_y", "_q").transform(filled)
        flag = measured.when(F.col("_p").isNotNull(), 1).otherwise(2)
        return filled.withColumn("filled", F.coalesce("_y", "_q")).withColumn("fill_flag", flag), first.transform(known.where(~part)).select(target, "_p")

    own = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys], F.lit(True)) for r in df.select(*keys).distinct().orderBy(*keys).collect()]
    done = [one(d.where(x)) for x in own] or [one(d)]
    tests = [x for _, x in done if x is not None]
    scores = {m: RegressionEvaluator(labelCol=target, predictionCol="_p", metricName=m).evaluate(reduce(DataFrame.unionByName, tests)) for m in ("r2", "rmse", "mae")} if tests else {}
    return reduce(DataFrame.unionByName, [x.select(*df.columns, "filled", "fill_flag") for x, _ in done]), scores


def quality_breakdown(df: DataFrame, keys: list[str], method: str = "method", window: str = "window") -> DataFrame:
    """(keys, flag, n, percent): records by the step that filled them, 0 for measured ones and those left; in percent of all."""
    from aeolith.functions.meteo import mds_flag

    n = df.groupBy(*keys, F.coalesce(mds_flag(F.col(method), F.col(window)), F.lit(0)).alias("flag")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
