"""Values in bins of one or two axes. Edges are small; they are joined once and rows stay in place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Distinct values up to which one task may hold them with their counts; beyond, quantiles of a whole table are found cell by cell.
DISTINCT = 2_000_000


def exact_quantiles(df: DataFrame, x: str, shares: list[float], cells: int = 1000) -> list[float]:
    """Quantiles by linear interpolation between ranks, as percentile() has them, of any number of values.

    Approximate quantiles part the values into cells, whose counts tell in which cell each rank lies; only the values of
    those cells are ranked, each cell by a task of its own. An empty column gives none.
    """
    v = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"))
    edges = v.agg(F.percentile_approx("x", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    e = F.array(*[F.lit(float(q)) for q in sorted(set(edges))]).cast("array<double>")
    counted = v.groupBy("x").agg(F.count("*").alias("m")).withColumn("cell", F.size(F.filter(e, lambda q: q < F.col("x"))))
    sizes = {r["cell"]: r["n"] for r in counted.groupBy("cell").agg(F.sum("m").alias("n")).collect()}
    n, before, start = sum(sizes.values()), 0, {}
    if not n:
        return []
    for c in sorted(sizes):
        start[c] = before
        before += sizes[c]
    ranks = sorted({f(p * (n - 1)) for p in shares for f in (math.floor, math.ceil)})
    need = {r: max(c for c, a in start.items() if a <= r) for r in ranks}
    w = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    own = counted.where(F.col("cell").isin(sorted(set(need.values())))).withColumn("z", F.sum("m").over(w)).withColumn("a", F.col("z") - F.col("m"))
    wanted = df.sparkSession.createDataFrame([(r, c, r - start[c]) for r, c in need.items()], "rank long, cell int, at long")
    at = {r["rank"]: r["x"] for r in own.join(F.broadcast(wanted), "cell").where("at >= a AND at < z").select("rank", "x").collect()}
    low = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in shares]
    return [at[a] + (at[b] - at[a]) * (q - a) for q, a, b in low]


def quantile_edges(df: DataFrame, keys: list[str], x: str, n: int) -> DataFrame:
    """(keys, edges): n + 1 distinct quantiles at most. Without keys, a column of very many distinct values goes cell by cell."""
    if not keys and (df.agg(F.approx_count_distinct(x)).first()[0] or 0) > DISTINCT:
        found = sorted(set(exact_quantiles(df, x, [i / n for i in range(n + 1)])))
        return df.sparkSession.createDataFrame([(found,)], "edges array<double>")
    q = F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)]))
    return df.groupBy(*keys).agg(F.array_distinct(q).alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of the bin (lo, hi], the first closed below; from 0, null outside."""
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1)) & (F.size(edges) > 1)
    return F.when(inside, F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0)))


def group_by_quantiles(df: DataFrame, keys: list[str], x: str, y: str, n: int = 10) -> DataFrame:
    """Statistics of y in quantile bins of x, and each bin's start."""
    d = df.where(F.col(x).isNotNull()).join(quantile_edges(df, keys, x, n), keys) if keys else df.where(F.col(x).isNotNull()).join(F.broadcast(quantile_edges(df, keys, x, n)), F.lit(True))
    d = d.withColumn("bin", bin_of(F.col(x), F.col("edges"))).withColumn("bin_start", F.col("edges")[F.col("bin")])
    return d.groupBy(*keys, "bin", "bin_start").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"), F.max(y).alias("max"), F.percentile(y, F.lit(0.25)).alias("q25"), F.percentile(y, F.lit(0.75)).alias("q75"))


def histogram(df: DataFrame, keys: list[str], v: str = "v", n: int = 10, drop_first: int = 0, drop_last: int = 0) -> DataFrame:
    """(keys, bin, bin_start, count): n equal bins from least to most, the last closed, empty ones too."""
    ends = df.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo IS NOT NULL")
    d = df.where(F.col(v).isNotNull()).join(ends, keys)
    width = (F.col("hi") - F.col("lo")) / n
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(v) - F.col("lo")) / F.when(width > 0, width)), F.lit(n - 1))).otherwise(0)
    c = d.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    out = grid.join(c, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), F.coalesce("c", F.lit(0)).cast("long").alias("count"))
    return out.where(F.col("bin").between(drop_first, n - 1 - drop_last))


def peak_bins(h: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k fullest bins, ties to the lower one."""
    return h.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "bin"))).where(F.col("rank") <= k)


def grid(df: DataFrame, x: str, y: str, z: str, n: int = 10, how: str = "equal", agg: str = "avg", least: int = 1) -> DataFrame:
    """(xbin, ybin, x_start, y_start, n, z): z by cells of equal-width or quantile bins of both axes; null below ``least`` values. Empty cells are kept."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    if how == "quantile":
        e = quantile_edges(d, [], x, n).withColumnRenamed("edges", "ex").crossJoin(quantile_edges(d, [], y, n).withColumnRenamed("edges", "ey"))  # a row each
    else:
        e = d.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        steps = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.col(a) + (F.col(b) - F.col(a)) * i / n)
        e = e.withColumn("ex", steps("x0", "x1")).withColumn("ey", steps("y0", "y1"))
    e = e.select("ex", "ey")  # one row
    cells = e.select("ex", "ey", F.explode(F.sequence(F.lit(0), F.size("ex") - 2)).alias("xbin")).select("*", F.explode(F.sequence(F.lit(0), F.size("ey") - 2)).alias("ybin"))
    cells = cells.select("xbin", "ybin", F.col("ex")[F.col("xbin")].alias("x_start"), F.col("ey")[F.col("ybin")].alias("y_start"))
    got = d.join(F.broadcast(e), F.lit(True)).select(bin_of(F.col(x), F.col("ex")).alias("xbin"), bin_of(F.col(y), F.col("ey")).alias("ybin"), F.col(z).alias("z"))
    got = got.groupBy("xbin", "ybin").agg(F.count("*").alias("n"), F.expr(f"{agg}(z)").alias("z"))
    return cells.join(got, ["xbin", "ybin"], "left").select("xbin", "ybin", "x_start", "y_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") >= least, F.col("z")).alias("z"))


def wind_rose(df: DataFrame, direction: str, v: str, sectors: int = 8) -> DataFrame:
    """Statistics by sector of direction; 360 is 0, values outside [0, 360] go."""
    width = 360.0 / sectors
    d = df.where(F.col(direction).between(0, 360))
    s = F.floor((F.col(direction) + width / 2) % 360 / width).cast("int")
    return d.groupBy(s.alias("sector")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"), F.sum(v).alias("sum"))


def compound_extremes(df: DataFrame, a: str, b: str, threshold: float = 2.0, a_high: bool = True, b_high: bool = False, ts: str = "ts") -> DataFrame:
    """Monthly means as z-scores within their calendar month (two years at least), and whether either or both are extreme."""
    m = df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.avg(a).alias("a"), F.avg(b).alias("b"))
    w = Window.partitionBy("month")
    z = lambda c: F.when(F.count(c).over(w) >= 2, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))
    m = m.withColumn("za", z("a")).withColumn("zb", z("b"))
    over = lambda c, high: F.coalesce(F.col(c) >= threshold if high else F.col(c) <= -threshold, F.lit(False))
    x, y = over("za", a_high), over("zb", b_high)
    return m.withColumn("category", F.when(x & y, "compound").when(x, "first").when(y, "second").otherwise("none"))


def stratified(df: DataFrame, z: str, x: str, y: str, n_z: int = 4, n_x: int = 2) -> DataFrame:
    """Median, count and spread of y in quantile bins of x inside quantile strata of z; strata with fewer bins are left out."""
    d = df.where(F.col(z).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    e = quantile_edges(d, [], z, n_z).withColumnRenamed("edges", "ez")
    d = d.join(F.broadcast(e), F.lit(True)).withColumn("zbin", bin_of(F.col(z), F.col("ez"))).drop("ez")
    d = d.join(quantile_edges(d, ["zbin"], x, n_x), "zbin").where(F.size("edges") == n_x + 1).withColumn("xbin", bin_of(F.col(x), F.col("edges")))
    return d.groupBy("zbin", "xbin").agg(F.count("*").alias("n"), F.percentile(y, F.lit(0.5)).alias("median"), F.percentile(y, F.lit(0.16)).alias("p16"), F.percentile(y, F.lit(0.84)).alias("p84"))


def optimum_range(df: DataFrame, x: str, y: str, n: int = 100, window: float = 0.1, threshold: float = 0.95) -> DataFrame:
    """One row: the bin of x with the highest smoothed median of y, and the contiguous range around it within the threshold of it."""
    b = group_by_quantiles(df, [], x, y, n).select("bin", "bin_start", F.col("median").alias("m"))
    k = int(n * window)
    k += 1 - k % 2
    w = Window.partitionBy().orderBy("bin")  # over the bins only
    b = b.withColumn("s", F.avg("m").over(w.rowsBetween(-(k // 2), k // 2)))
    top = Window.partitionBy()
    b = b.withColumn("best", F.max_by("bin", F.struct(F.round("s", 9), -F.col("bin"))).over(top)).withColumn("peak", F.max("s").over(top))
    b = b.withColumn("out", F.col("s") < threshold * F.col("peak"))
    b = b.withColumn("lo", F.max(F.when(F.col("out") & (F.col("bin") < F.col("best")), F.col("bin"))).over(top)).withColumn("hi", F.min(F.when(F.col("out") & (F.col("bin") > F.col("best")), F.col("bin"))).over(top))
    inside = b.where((F.col("bin") > F.coalesce("lo", F.lit(-1))) & (F.col("bin") < F.coalesce("hi", F.lit(n))))
    return inside.agg(F.max("best").alias("best_bin"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.min("bin_start").alias("range_start"), F.max("peak").alias("peak"))
