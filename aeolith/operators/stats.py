"""Summary statistics. Every function groups by keys; percentiles interpolate linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators.timeaxis import seconds_between

LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def skewness(v: str) -> Column:
    """Bias-corrected; null below three values."""
    n = F.count(v)
    return F.when(n >= 3, F.skewness(v) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurtosis(v: str) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(v).cast("double")
    return F.when(n >= 4, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over complete pairs; null where one side doesn't vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def valid_numbers(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """Rows with a value, their number from 0 and the value before, among such rows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.where(F.col(v).isNotNull()).withColumn("r", F.row_number().over(w) - 1).withColumn("before", F.lag(v).over(w))


def summary(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v", threshold: float = 3.0) -> DataFrame:
    """One row a series: extent, counts, moments, percentiles, change, trend, lag-1 autocorrelation, outliers by z-score."""
    p = F.percentile(v, F.array(*map(F.lit, LEVELS)))
    whole = df.groupBy(*keys).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), seconds_between(F.max(ts), F.min(ts)).alias("period_seconds"), F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("missing"),
        ((F.count("*") - F.count(v)) / F.count("*") * 100).alias("missing_percent"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("var"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("sd_over_mean"),
        F.try_divide(F.stddev_samp(v), F.abs(F.avg(v))).alias("cv"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), skewness(v).alias("skew"), kurtosis(v).alias("kurtosis"), p.alias("p"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"),
    )
    whole = whole.select("*", *[F.col("p")[i].alias(f"p{int(q * 100):02d}") for i, q in enumerate(LEVELS)], (F.col("p")[4] - F.col("p")[2]).alias("iqr")).drop("p")
    d = valid_numbers(df, keys, ts, v).groupBy(*keys).agg(F.avg(F.abs(F.col(v) - F.col("before"))).alias("mean_abs_change"), F.regr_slope(v, "r").alias("trend_slope"), correlation(v, "before").alias("acf1"))
    far = df.join(whole.select(*keys, "_m", "_s"), keys).groupBy(*keys).agg(F.count_if(F.abs(F.col(v) - F.col("_m")) > threshold * F.col("_s")).alias("outliers"))
    return whole.join(d, keys, "left").join(far, keys).withColumn("outlier_percent", F.try_divide(F.col("outliers") * 100, F.col("n"))).drop("_m", "_s")


def double_difference(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """|x - previous|, |x - next| and their sum; null at the ends and beside gaps."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("to_previous", F.abs(F.col(v) - F.lag(v).over(w))).withColumn("to_next", F.abs(F.col(v) - F.lead(v).over(w)))
    return d.withColumn("both", F.col("to_previous") + F.col("to_next"))


def trend(df: DataFrame, keys: list[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """Least squares on the number of the valid record: slope, intercept, r (not negative)."""
    return valid_numbers(df, keys, ts, v).groupBy(*keys).agg(F.regr_slope(v, "r").alias("slope"), F.regr_intercept(v, "r").alias("intercept"), F.sqrt(F.regr_r2(v, "r")).alias("r"))


def outlier_counts(df: DataFrame, keys: list[str], threshold: float = 3.0, v: str = "v") -> DataFrame:
    """Values beyond the threshold by z-score (population SD), by interquartile range and by median absolute deviation (0 if that is 0)."""
    s = df.groupBy(*keys).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = df.join(s, keys)
    mad = d.groupBy(*keys).agg(F.percentile(F.abs(F.col(v) - F.col("q")[1]), F.lit(0.5)).alias("mad"))
    iqr = F.col("q")[2] - F.col("q")[0]
    x = F.col(v)
    return d.join(mad, keys).groupBy(*keys).agg(
        F.count_if(F.abs(x - F.col("m")) > threshold * F.col("s")).alias("by_zscore"), F.count_if((x < F.col("q")[0] - threshold * iqr) | (x > F.col("q")[2] + threshold * iqr)).alias("by_iqr"),
        F.count_if((F.col("mad") > 0) & (F.abs(x - F.col("q")[1]) * 0.6745 > threshold * F.col("mad"))).alias("by_mad"),
    )


def percentiles(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """(keys, percentile, value) for 0 to 100."""
    p = df.groupBy(*keys).agg(F.percentile(v, F.array(*[F.lit(i / 100) for i in range(101)])).alias("p"))
    return p.select(*keys, F.posexplode("p").alias("percentile", "value"))


def circular(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """Mean direction in degrees from mean sine and cosine."""
    r = F.radians(F.col(angle))
    m = df.groupBy(*keys).agg(F.avg(F.sin(r)).alias("s"), F.avg(F.cos(r)).alias("c"))
    d = F.degrees(F.atan2("s", "c"))
    return m.select(*keys, F.when(d < 0, d + 360).otherwise(d).alias("direction"))


def scores(df: DataFrame, predicted: str, target: str, keys: list[str]) -> DataFrame:
    """Errors of predictions on complete rows."""
    d = df.where(F.col(predicted).isNotNull() & F.col(target).isNotNull())
    e = F.col(target) - F.col(predicted)
    mean = F.avg(F.col(target)).over(Window.partitionBy(*keys))
    d = d.withColumn("_e", e).withColumn("_t", (F.col(target) - mean) ** 2)
    return d.groupBy(*keys).agg(
        F.avg(F.abs("_e")).alias("mae"), F.percentile(F.abs("_e"), F.lit(0.5)).alias("medae"), F.avg(F.col("_e") ** 2).alias("mse"), F.sqrt(F.avg(F.col("_e") ** 2)).alias("rmse"),
        F.avg(F.abs(F.try_divide(F.col("_e"), F.col(target)))).alias("mape"), F.max(F.abs("_e")).alias("max_error"), (1 - F.try_divide(F.sum(F.col("_e") ** 2), F.sum("_t"))).alias("r2"),
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: count, missing, distinct, zeros, constant, moments, median.

    Cells are counted by column and value first, so that a frequent value is one row from there on; distinct values,
    moments and the median all come from these counts.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])).alias("s")).select("s.i", "s.x")
    n = cells.groupBy("i", "x").agg(F.count("*").alias("m"))
    m = F.when(F.col("x").isNotNull(), F.col("m")).otherwise(0)
    t = n.groupBy("i").agg(
        F.sum(m).alias("n"), F.sum(F.when(F.col("x").isNull(), F.col("m")).otherwise(0)).alias("missing"), F.count("x").alias("distinct"), F.sum(F.when(F.col("x") == 0, F.col("m")).otherwise(0)).alias("zeros"), F.sum(F.col("x") * F.col("m")).alias("_s"),
        F.min("x").alias("min"), F.percentile("x", F.lit(0.5), F.col("m")).alias("median"), F.max("x").alias("max"),
    )
    mean = t.select("i", (F.col("_s") / F.col("n")).alias("mean"))
    sd = n.join(F.broadcast(mean), "i").groupBy("i").agg(F.sqrt(F.try_divide(F.sum(F.col("m") * (F.col("x") - F.col("mean")) ** 2), F.sum(m) - 1)).alias("sd"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    out = t.join(F.broadcast(mean), "i").join(F.broadcast(sd), "i")
    return out.select(names.alias("column"), "n", "missing", "distinct", "zeros", "mean", "sd", "min", "median", "max", (F.col("distinct") == 1).alias("constant"))


def daily_correlation(df: DataFrame, keys: list[str], a: str, b: str, ts: str = "ts") -> DataFrame:
    """Pearson's r of two columns in each day."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.when(F.count("*") > 1, correlation(a, b)).alias("r"))


def rank_drivers(df: DataFrame, keys: list[str], target: str, features: list[str], max_lag: int = 0, least: int = 30, ts: str = "ts") -> DataFrame:
    """(keys, feature, lag, r, n): for each feature the lag of largest |r| on complete pairs, if at least ``least`` of them."""
    w = Window.partitionBy(*keys).orderBy(ts)
    lags = [(f, k) for f in features for k in range(-max_lag, max_lag + 1)]
    d = df.select(*keys, target, *[F.lag(f, k).over(w).alias(f"_{i}") if k >= 0 else F.lead(f, -k).over(w).alias(f"_{i}") for i, (f, k) in enumerate(lags)])
    r = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), correlation(target, f"_{i}").alias("r"), F.count_if(F.col(target).isNotNull() & F.col(f"_{i}").isNotNull()).alias("n")) for i, (f, k) in enumerate(lags)]
    long = d.groupBy(*keys).agg(F.array(*r).alias("a")).select(*keys, F.inline("a")).where((F.col("n") >= least) & F.col("r").isNotNull())
    best = Window.partitionBy(*keys, "feature").orderBy(F.desc(F.round(F.abs("r"), 9)), F.abs("lag"), "lag")
    return long.withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b")


def overview(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: rows, columns, cells, missing cells and their share, repeated stamps, repeated rows, first and last stamp."""
    n, cells = F.count("*"), len(df.columns)
    missing = sum((F.count("*") - F.count(f"`{c}`") for c in df.columns[1:]), F.count("*") - F.count(f"`{df.columns[0]}`"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("_all", whole).agg(
        n.alias("rows"), F.lit(cells).alias("columns"), (n * cells).alias("cells"), missing.alias("missing_cells"), F.try_divide(missing * 100, n * cells).alias("missing_percent"),
        (F.count(ts) - F.countDistinct(ts)).alias("repeated_stamps"), (n - F.countDistinct("_all")).alias("repeated_rows"), F.min(ts).alias("start"), F.max(ts).alias("end"),
    )


def unique_values(df: DataFrame) -> DataFrame:
    """Distinct values over all cells, as text."""
    return df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("value")).distinct()


def days_by_correlation(days: DataFrame, high: bool = True) -> DataFrame:
    """Days of daily_correlation by |r|, the largest or the smallest first, as rank."""
    r = F.abs("r")
    return days.where("r IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy(*[c for c in days.columns if c not in ("day", "n", "r")]).orderBy(r.desc() if high else r.asc(), "day")))


def unusual_days(days: DataFrame, keys: list[str], threshold: float = 2.0, how: str = "zscore") -> DataFrame:
    """Days of daily_correlation whose r stands out by z-score, or by distance from the quartiles in their ranges; with score."""
    w = Window.partitionBy(*keys)
    if how == "zscore":
        score = F.try_divide(F.abs(F.col("r") - F.avg("r").over(w)), F.stddev_samp("r").over(w))
    else:
        q1, q3 = (F.percentile("r", F.lit(q)).over(w) for q in (0.25, 0.75))
        score = F.try_divide(F.greatest(q1 - F.col("r"), F.col("r") - q3, F.lit(0.0)), q3 - q1)
    return days.where("r IS NOT NULL").withColumn("score", score).where(F.col("score") > threshold)
