"""Queries over whole tables: daily orders, line items, coded numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.functions import codes
from aeolith.operators import binning, quality, resample, stats, timeaxis
from aeolith.plans.registry import OFF_HALF, query
from aeolith.plans.series import R, events


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("p"))
    return o.groupBy("ts").agg(F.round(F.avg("p") / 1000 + OFF_HALF, 4).alias("v"), F.round(F.sum("p"), 2).alias("total"), F.count("*").alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def Q(x: str, n: int) -> str:
    """n + 1 distinct quantiles at most, in order."""
    return f"list_sort(list_distinct(quantile_cont({x}, [" + ", ".join(str(i / n) for i in range(n + 1)) + "])))"


def B(x: str, edges: str) -> str:
    """Number of the bin of x, from 0."""
    return f"CASE WHEN len({edges}) > 1 AND {x} BETWEEN {edges}[1] AND {edges}[-1] THEN greatest(len(list_filter({edges}, lambda q: q < {x})) - 1, 0) END"


D = "WITH s AS (SELECT o_orderdate::TIMESTAMP AS ts, round(avg(o_totalprice) / 1000 + 1.3e-8, 4) AS v, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)"


@query(f"{D}, m AS (SELECT year(ts)::INT AS year, month(ts) AS m, avg(v) AS v FROM s GROUP BY 1, 2) SELECT year, " + ", ".join(f"{R(f'max(v) FILTER (m = {i})')} AS \"{i}\"" for i in range(1, 13)) + " FROM m GROUP BY year")
def month_matrix(spark, sf_dir):
    return resample.month_matrix(daily_orders(spark, sf_dir))


@query(f"{D}, m AS (SELECT year(ts)::INT AS year, month(ts)::INT AS month, avg(v) AS v FROM s GROUP BY 1, 2) SELECT year, month, {R('v')} AS v, dense_rank() OVER (PARTITION BY month ORDER BY round(v, 9) DESC)::INT AS rank FROM m")
def month_ranks(spark, sf_dir):
    return resample.month_ranks(daily_orders(spark, sf_dir), "avg")


@query(f"{D}, m AS (SELECT year(ts)::INT AS year, month(ts)::INT AS month, avg(v) AS v FROM s GROUP BY 1, 2), g AS (SELECT year, unnest(range(1, 13))::INT AS month FROM (SELECT DISTINCT year FROM m)) SELECT year, month, {R('v')} AS v FROM g LEFT JOIN m USING (year, month)")
def month_matrix_long(spark, sf_dir):
    return resample.long_months(resample.month_matrix(daily_orders(spark, sf_dir)))


@query(f"{D} SELECT year(ts)::INT AS year, {R('dayofyear(ts)::DOUBLE')} AS doy_time, {R('sum(v) OVER (PARTITION BY year(ts) ORDER BY ts)')} AS cumulative FROM s")
def yearly_cumulatives(spark, sf_dir):
    return resample.yearly_cumulatives(daily_orders(spark, sf_dir))


@query(f"""{D}, c AS (SELECT year(ts) AS year, dayofyear(ts)::DOUBLE AS doy_time, sum(v / 1e3) OVER (PARTITION BY year(ts) ORDER BY ts) AS c FROM s), m AS (SELECT doy_time, avg(c) AS m, stddev_samp(c) AS sd FROM c WHERE year <> 1995 GROUP BY 1)
SELECT {R('doy_time')} AS doy_time, {R('m')} AS mean, {R('sd')} AS sd, {R('m + sd')} AS plus_sd, {R('m - sd')} AS minus_sd, {R('m + 1.96 * sd')} AS plus_ci, {R('m - 1.96 * sd')} AS minus_ci FROM m""")
def mean_cumulative(spark, sf_dir):
    return resample.mean_cumulative(resample.yearly_cumulatives(daily_orders(spark, sf_dir).withColumn("v", F.col("v") / 1e3)), [1995])


@query(f"""{D}, y AS (SELECT year(ts)::INT AS year, avg(v) AS v FROM s GROUP BY 1), r AS (SELECT avg(v) AS r, min(year) AS a, max(year) AS z FROM y WHERE year BETWEEN 1995 AND 1997), e AS (SELECT min(year) AS a, max(year) AS z FROM y),
g AS (SELECT unnest(range(a, z + 1))::INT AS year FROM e) SELECT year, {R('v')} AS v, {R('v - r')} AS anomaly FROM g LEFT JOIN y USING (year), r""")
def long_term_anomalies(spark, sf_dir):
    return resample.long_term_anomalies(daily_orders(spark, sf_dir), 1995, 1997)


@query(f"""{D}, m AS (SELECT year(ts)::INT AS year, month(ts)::INT AS month, avg(v) AS a, avg(n) AS b FROM s GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN count(a) OVER w >= 2 THEN (a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0) END AS za, CASE WHEN count(b) OVER w >= 2 THEN (b - avg(b) OVER w) / nullif(stddev_samp(b) OVER w, 0) END AS zb FROM m WINDOW w AS (PARTITION BY month))
SELECT year, month, {R('a')} AS a, {R('b')} AS b, {R('za')} AS za, {R('zb')} AS zb, CASE WHEN coalesce(za >= 1, false) AND coalesce(zb <= -1, false) THEN 'compound' WHEN coalesce(za >= 1, false) THEN 'first' WHEN coalesce(zb <= -1, false) THEN 'second' ELSE 'none' END AS category FROM z""")
def compound_extremes(spark, sf_dir):
    return binning.compound_extremes(daily_orders(spark, sf_dir), "v", "n", 1.0)


@query(f"{D} SELECT ts, {R('v')} AS v, n FROM s WHERE strftime(ts, '%m-%d') <= '06-30' AND v IS NOT NULL AND year(ts) BETWEEN 1996 AND 1998")
def before_day_of_year(spark, sf_dir):
    d = timeaxis.keep_years(daily_orders(spark, sf_dir), 1996, 1998)
    return timeaxis.before_day_of_year(d, "06-30", "v").select("ts", "v", "n")


@query(f"""{D}, y AS (SELECT DISTINCT year(ts) AS y FROM s), p AS (SELECT a.y AS pool, b.y, row_number() OVER (PARTITION BY a.y ORDER BY abs(b.y - a.y), b.y) AS r FROM y a, y b), q AS (SELECT pool, min(y) AS a, max(y) AS z FROM p WHERE r <= 3 GROUP BY 1)
SELECT pool::INT AS pool_year, count(*) AS n, {R('avg(v)')} AS mean FROM s JOIN q ON year(ts) BETWEEN a AND z GROUP BY 1""")
def neighbouring_years(spark, sf_dir):
    return timeaxis.neighbouring_years(daily_orders(spark, sf_dir)).groupBy("pool_year").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query("""WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, [i / 10 for i in range(0, 11)])) AS e FROM lineitem), u AS (SELECT list_sort(list(DISTINCT e)) AS e FROM q),
b AS (SELECT l_discount AS y, greatest(len(list_filter(u.e, lambda x: x < l_extendedprice)) - 1, 0) AS bin, u.e FROM lineitem, u)
SELECT bin::INT AS bin, (round(e[bin + 1], 6) + 0.0) AS bin_start, count(y) AS n, (round(avg(y), 6) + 0.0) AS mean, (round(median(y), 6) + 0.0) AS median, (round(stddev_samp(y), 6) + 0.0) AS sd, (round(min(y), 6) + 0.0) AS min, (round(max(y), 6) + 0.0) AS max, (round(quantile_cont(y, 0.25), 6) + 0.0) AS q25, (round(quantile_cont(y, 0.75), 6) + 0.0) AS q75 FROM b GROUP BY 1, 2""")
def quantile_bins(spark, sf_dir):
    return binning.group_by_quantiles(lines(spark, sf_dir), [], "l_extendedprice", "l_discount", 10)


GRID = """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem), ee AS (SELECT [x0 + (x1 - x0) * i / 5 for i in range(0, 6)] AS ex, [y0 + (y1 - y0) * i / 5 for i in range(0, 6)] AS ey FROM e),
c AS (SELECT ex, ey, a.a AS xbin, b.b AS ybin FROM ee, (SELECT unnest(range(0, 5)) AS a) a, (SELECT unnest(range(0, 5)) AS b) b),
g AS (SELECT greatest(len(list_filter(ex, lambda i: i < l_quantity)) - 1, 0) AS xbin, greatest(len(list_filter(ey, lambda i: i < l_extendedprice)) - 1, 0) AS ybin, count(*) AS n, avg(l_discount) AS z FROM lineitem, ee GROUP BY 1, 2)
SELECT xbin::INT AS xbin, ybin::INT AS ybin, (round(ex[xbin + 1], 6) + 0.0) AS x_start, (round(ey[ybin + 1], 6) + 0.0) AS y_start, coalesce(n, 0) AS n, (round(CASE WHEN n >= 5 THEN z END, 6) + 0.0) AS z FROM c LEFT JOIN g USING (xbin, ybin)"""


@query(GRID)
def grid_equal_width(spark, sf_dir):
    return binning.grid(lines(spark, sf_dir), "l_quantity", "l_extendedprice", "l_discount", 5, least=5)


@query(f"""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem), e AS (SELECT {Q('x', 5)} AS ex, {Q('y', 5)} AS ey FROM d),
c AS (SELECT xbin, ybin, ex[xbin + 1] AS x_start, ey[ybin + 1] AS y_start FROM (SELECT ex, ey, unnest(range(len(ex) - 1))::INT AS xbin FROM e), (SELECT unnest(range(len(ey) - 1))::INT AS ybin FROM e)),
g AS (SELECT {B('x', 'ex')} AS xbin, {B('y', 'ey')} AS ybin, count(*) AS n, avg(z) AS z FROM d, e GROUP BY 1, 2) SELECT c.xbin, c.ybin, {R('x_start')} AS x_start, {R('y_start')} AS y_start, coalesce(n, 0) AS n, {R('z')} AS z FROM c LEFT JOIN g USING (xbin, ybin)""")
def grid_quantile(spark, sf_dir):
    return binning.grid(lines(spark, sf_dir), "l_quantity", "l_extendedprice", "l_discount", 5, "quantile")


@query(f"""WITH d AS (SELECT l_quantity AS z, l_extendedprice AS x, l_discount AS y FROM lineitem), e AS (SELECT {Q('z', 4)} AS ez FROM d), s AS (SELECT x, y, ({B('z', 'ez')})::INT AS zbin FROM d, e), f AS (SELECT zbin, {Q('x', 3)} AS ex FROM s GROUP BY 1)
SELECT s.zbin, ({B('x', 'ex')})::INT AS xbin, count(*) AS n, {R('median(y)')} AS median, {R('quantile_cont(y, 0.16)')} AS p16, {R('quantile_cont(y, 0.84)')} AS p84 FROM s JOIN f ON s.zbin = f.zbin WHERE len(ex) = 4 GROUP BY 1, 2""")
def stratified_analysis(spark, sf_dir):
    return binning.stratified(lines(spark, sf_dir), "l_quantity", "l_extendedprice", "l_discount", 4, 3)


@query(f"""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT {Q('x', 40)} AS ex FROM d), b AS (SELECT ({B('x', 'ex')})::INT AS bin, median(y) AS m, any_value(ex) AS ex FROM d, e GROUP BY 1),
s AS (SELECT bin, ex[bin + 1] AS bin_start, avg(m) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM b), t AS (SELECT arg_max(bin, (round(s, 9), -bin)) AS best, max(s) AS peak FROM s), o AS (SELECT max(bin) FILTER (s < 0.95 * peak AND bin < best) AS lo, min(bin) FILTER (s < 0.95 * peak AND bin > best) AS hi FROM s, t)
SELECT any_value(best) AS best_bin, min(bin) AS first_bin, max(bin) AS last_bin, {R('min(bin_start)')} AS range_start, {R('max(peak)')} AS peak FROM s, t, o WHERE bin > coalesce(lo, -1) AND bin < coalesce(hi, 40)""")
def optimum_range(spark, sf_dir):
    return binning.optimum_range(lines(spark, sf_dir), "l_quantity", "l_extendedprice", 40)


@query("""WITH w AS (SELECT l_quantity * 7.3 AS d, l_extendedprice AS v FROM lineitem), s AS (SELECT floor(((d + 22.5) % 360) / 45)::INT AS sector, v FROM w WHERE d BETWEEN 0 AND 360)
SELECT sector, count(v) AS n, (round(avg(v), 6) + 0.0) AS mean, (round(median(v), 6) + 0.0) AS median, (round(min(v), 6) + 0.0) AS min, (round(max(v), 6) + 0.0) AS max, (round(stddev_samp(v), 6) + 0.0) AS sd, (round(sum(v), 2) + 0.0) AS sum FROM s GROUP BY 1""")
def wind_rose(spark, sf_dir):
    d = lines(spark, sf_dir).select((F.col("l_quantity") * 7.3).alias("d"), F.col("l_extendedprice").alias("v"))
    return binning.wind_rose(d, "d", "v").withColumn("sum", F.round("sum", 2))


PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", count_if({c} = 0)::BIGINT AS zeros, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS sd, {R(f'min({c})')} AS min, {R(f'median({c})')} AS median, {R(f'max({c})')} AS max, count(DISTINCT {c}) = 1 AS constant FROM lineitem" for c in PROFILED))
def profile_frame(spark, sf_dir):
    return stats.profile(lines(spark, sf_dir), list(PROFILED))


@query("""SELECT l_returnflag, l_shipdate::DATE AS day, count(*) AS n, (round(CASE WHEN count(*) > 1 THEN corr(l_quantity, l_extendedprice) END, 6) + 0.0) AS r FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1 AND count(DISTINCT l_extendedprice) > 1""")
def daily_correlation(spark, sf_dir):
    d = stats.daily_correlation(lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_shipdate")
    return d.where("r IS NOT NULL")


@query("""WITH p AS (SELECT l_returnflag AS k, l_extendedprice AS t, l_quantity * 1500.0 AS p FROM lineitem), e AS (SELECT *, t - p AS e, avg(t) OVER (PARTITION BY k) AS m FROM p)
SELECT k, (round(avg(abs(e)), 6) + 0.0) AS mae, (round(median(abs(e)), 6) + 0.0) AS medae, (round(avg(e * e), 2) + 0.0) AS mse, (round(sqrt(avg(e * e)), 6) + 0.0) AS rmse, (round(avg(abs(e / t)), 6) + 0.0) AS mape, (round(max(abs(e)), 6) + 0.0) AS max_error, (round(1 - sum(e * e) / sum((t - m) * (t - m)), 6) + 0.0) AS r2 FROM e GROUP BY k""")
def prediction_scores(spark, sf_dir):
    d = lines(spark, sf_dir).select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500.0).alias("p"))
    return stats.scores(d, "p", "t", ["k"]).withColumn("mse", F.round("mse", 2))


@query("""WITH b AS (SELECT event_id AS i, event_id % 997 AS c FROM events), t AS (SELECT i, c::VARCHAR AS s FROM b)
SELECT i, CASE WHEN substr(s, 2, 1) = '9' OR length(s) < 2 THEN NULL ELSE CAST(substr(s, 2, 1) AS INT) END AS digit_1, CASE WHEN substr(s, 1, 1) = '9' THEN NULL WHEN substr(s, 1, 1) = '1' THEN 2 ELSE CAST(substr(s, 1, 1) AS INT) END AS hard_0,
(round(((i % 256) >> 4)::DOUBLE * 0.5, 6) + 0.0) AS high_bits FROM t""")
def packed_codes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("i"), (F.col("event_id") % 997).alias("c"))
    return e.select("i", codes.digit(F.col("c"), 1).alias("digit_1"), codes.hard_flag(F.col("c"), 0).alias("hard_0"), codes.bits(F.col("i") % 256, 0, 4, 0.5).alias("high_bits"))


@query("""SELECT event_id, CASE WHEN value < 40 THEN 0 WHEN value < 80 THEN 1 ELSE 2 END AS scf, CASE WHEN value / 100 >= 0.99 THEN 0 WHEN value / 100 >= 0.97 THEN 1 ELSE 2 END AS completeness, CASE WHEN value < 25 THEN 2 ELSE 0 END AS signal FROM events""")
def quality_flags(spark, sf_dir):
    v = F.col("v")
    return events(spark, sf_dir).select("event_id", quality.threshold_flag(v, 40, 80).alias("scf"), quality.completeness_flag(v, F.lit(100.0)).alias("completeness"), quality.signal_strength_flag(v, 25).alias("signal"))


@query()
def driver_ranking(spark, sf_dir):
    d = lines(spark, sf_dir).select(F.col("l_returnflag").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), "l_quantity", "l_discount", "l_extendedprice")
    return stats.rank_drivers(d, ["k"], "l_extendedprice", ["l_quantity", "l_discount"], 1)
