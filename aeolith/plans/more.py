"""Queries of features, fits, plot tables, screening, self-heating, partitioning, long records and driver analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.operators import columns, corrections, decompose, drivers, engineer, fill, fits, flux, gaps, longterm, partition, screening, selfheating, shapes, stats, timeaxis
from aeolith.plans.frames import D, daily_orders, lines
from aeolith.plans.models import DEC, EOT, LAT, LON, OFFSET, H, halfhours
from aeolith.plans.registry import query
from aeolith.plans.series import R, S, Z, cte, series
from aeolith.sources import formats

#: Made-up drivers that follow the stamp, as in halfhours.
HH = "(hour(ts) + minute(ts) / 60)"
TA, SWIN = f"(10 + 8 * sin(({HH} - 9) * pi() / 12) + dayofyear(ts) / 30)", f"greatest(0.0, 500 * sin(({HH} - 6) * pi() / 12))"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_orders(spark, sf_dir).withColumn("k", F.lit("a"))


@query(f"""{S}, w AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) AS n FROM s)
SELECT k, ts, {R('lag(v) OVER o')} AS "a_m1", {R('lead(v) OVER o')} AS "a_p1", {R('avg(v) OVER (o ROWS 5 PRECEDING)')} AS "a_mean", {R('stddev_pop(v) OVER (o ROWS 5 PRECEDING)')} AS "a_sd",
{R('median(v) OVER (o ROWS 5 PRECEDING)')} AS "a_median", {R('v - 2 * lag(v) OVER o + lag(v, 2) OVER o')} AS "a_diff", {R('v * v')} AS "a_square", n FROM w WINDOW o AS (PARTITION BY k ORDER BY ts)""")
def engineered_features(spark, sf_dir):
    e = engineer.Engineer("target", lags=(-1, 1), rolling=(6,), statistics=("median",), differences=(2,), powers=2, record_number=True)
    d = e.transform(series(spark, sf_dir).withColumn("a", F.col("v")).withColumnRenamed("v", "target"), ["k"])
    names = {".a-1": "a_m1", ".a+1": "a_p1", ".a_MEAN6": "a_mean", ".a_SD6": "a_sd", ".a_ROLLMEDIAN6": "a_median", ".a_DIFF2": "a_diff", ".a_POL2": "a_square", ".RECORDNUMBER": "n"}
    return d.select("k", "ts", *[F.col(f"`{a}`").alias(b) for a, b in names.items()]).withColumn("n", F.col("n").cast("long"))


@query(f"""{D}, x AS (SELECT ts, v, row_number() OVER (ORDER BY ts) AS n FROM s), e AS (WITH RECURSIVE r AS (SELECT n, v AS m FROM x WHERE n = 1 UNION ALL SELECT x.n, 2 / 13.0 * x.v + 11 / 13.0 * r.m FROM r JOIN x ON x.n = r.n + 1) SELECT * FROM r)
SELECT ts, {R('m')} AS ema FROM e JOIN x USING (n)""")
def exponential_mean(spark, sf_dir):
    d = engineer.Engineer("total", exponential=(12,)).transform(daily(spark, sf_dir).select("k", "ts", "total", "v"), ["k"])
    return d.select("ts", F.col("`.v_EMA12`").alias("ema"))


@query(f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem)
SELECT {R('b')} AS slope, {R('a')} AS intercept, {R('r2')} AS r2, {R('1 - (1 - r2) * (n - 1) / (n - 2)')} AS adjusted_r2, n FROM f""")
def linear_fit(spark, sf_dir):
    c = fits.fit_curve(lines(spark, sf_dir), "l_quantity", "l_extendedprice", "linear")
    return spark.createDataFrame([(*c.coefficients, c.r2, c.adjusted_r2, c.n)], "slope double, intercept double, r2 double, adjusted_r2 double, n long")


@query()
def binned_curve_fit(spark, sf_dir):
    c = fits.fit_curve(lines(spark, sf_dir), "l_quantity", "l_extendedprice", "quadratic_offset", 10)
    return spark.createDataFrame(c.predictions(200))


@query(f"""{S} SELECT k, ts, {R(Z)} AS z, {R('avg(v) OVER (PARTITION BY k) + 2 * stddev_pop(v) OVER (PARTITION BY k)')} AS at_two FROM s""")
def zscores(spark, sf_dir):
    return series(spark, sf_dir).select("k", "ts", fits.zscore("v", ["k"]).alias("z"), fits.from_zscore("v", 2.0, ["k"]).alias("at_two"))


@query(f"{S} SELECT k, {R('arg_min(v, (abs(v - 50), v))')} AS nearest FROM (SELECT * FROM s WHERE v IS NOT NULL) GROUP BY k")
def nearest_value(spark, sf_dir):
    return fits.nearest_value(series(spark, sf_dir), ["k"], "v", 50.0)


@query()
def granger_causality(spark, sf_dir):
    return fits.granger(halfhours(spark, sf_dir), ["k"], "ta", "flux", 4)


@query()
def approximate_entropy(spark, sf_dir):
    return fits.approximate_entropy(daily(spark, sf_dir), ["k"])


@query()
def spectrogram(spark, sf_dir):
    return fits.spectrogram(daily(spark, sf_dir), ["k"], 128).drop("k")


@query(f"""{D}, m AS (SELECT date_trunc('month', ts)::TIMESTAMP AS ts, sum(v) AS c FROM s GROUP BY 1), t AS (SELECT *, sum(c) OVER (ORDER BY ts) AS z FROM m) SELECT ts, {R('c')} AS contribution, {R('z - c')} AS start, {R('z')} AS stop FROM t""")
def waterfall(spark, sf_dir):
    return shapes.waterfall(daily(spark, sf_dir), ["k"], "month").drop("k")


@query(f"""{D} SELECT year(ts)::INT AS year, floor((dayofyear(ts) - 1 + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400) / dayofyear(make_date(year(ts), 12, 31)) * 73)::INT AS slot, {R('avg(v)')} AS v FROM s GROUP BY 1, 2""")
def year_rings(spark, sf_dir):
    return shapes.year_rings(daily(spark, sf_dir), ["k"], 73).drop("k")


@query(f"""SELECT event_id, year(ts)::INT AS year, dayofyear(ts)::INT AS doy, {R('(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400')} AS fraction, {R('dayofyear(ts) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400')} AS doy_time FROM events""")
def calendar_fractions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return shapes.calendar(e).drop("ts")


@query(f"""{S} SELECT k, CAST(ts AS DATE) AS day, floor((hour(ts) * 60 + minute(ts)) / 30)::INT AS slot, {R('avg(v)')} AS v FROM s GROUP BY 1, 2, 3""")
def day_grid(spark, sf_dir):
    return shapes.day_grid(series(spark, sf_dir), ["k"], 30)


@query()
def kernel_density(spark, sf_dir):
    return shapes.density(series(spark, sf_dir), ["k"], 100)


@query()
def monthly_ridges(spark, sf_dir):
    return shapes.ridges(daily(spark, sf_dir), ["k"], "month", 50).drop("k")


@query(f"""{D}, r AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM s WHERE ts BETWEEN '1995-01-01' AND '1996-12-31'),
z AS (SELECT (v >= m - 3 * sd)::INT + (v >= m - sd)::INT + (v >= m + sd)::INT + (v >= m + 3 * sd)::INT AS zone, ts <= '1996-12-31' AS a FROM s, r WHERE ts BETWEEN '1995-01-01' AND '1998-12-31'),
n AS (SELECT zone, count_if(a) AS x, count_if(NOT a) AS y FROM z GROUP BY 1) SELECT zone, {R('x / sum(x) OVER ()')} AS reference, {R('y / sum(y) OVER ()')} AS other FROM n""")
def shifted_distribution(spark, sf_dir):
    return shapes.shifted(daily(spark, sf_dir), ["k"], ("1995-01-01", "1996-12-31"), ("1997-01-01", "1998-12-31")).select("zone", "reference", "other")


@query(f"""{D}, r AS (SELECT ts, v, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER () * 100 AS p FROM s) SELECT ts, {R('p')} AS percentile FROM r""")
def percentile_ranks(spark, sf_dir):
    return daily(spark, sf_dir).select("ts", shapes.percentile_rank("v", ["k"]).alias("percentile"))


@query(f"""WITH d AS (SELECT l_quantity AS x, l_discount AS y, l_extendedprice AS z FROM lineitem), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d),
u AS (SELECT z, (x - x0) / (x1 - x0) * 11 AS u, (y - y0) / (y1 - y0) * 6 AS v FROM d, e), t AS (SELECT z, round(u) AS i1, round(v) AS j1, floor(u) + 0.5 AS i2, floor(v) + 0.5 AS j2, u, v FROM u),
c AS (SELECT z, CASE WHEN (u - i1) ** 2 + 3 * (v - j1) ** 2 < (u - i2) ** 2 + 3 * (v - j2) ** 2 THEN i1 ELSE i2 END AS i, CASE WHEN (u - i1) ** 2 + 3 * (v - j1) ** 2 < (u - i2) ** 2 + 3 * (v - j2) ** 2 THEN j1 ELSE j2 END AS j FROM t)
SELECT {R('x0 + i / 11 * (x1 - x0)')} AS cx, {R('y0 + j / 6 * (y1 - y0)')} AS cy, count(*) AS n, {R('median(z)')} AS z FROM c, e GROUP BY i, j, x0, x1, y0, y1""")
def hexagons(spark, sf_dir):
    return shapes.hexagons(lines(spark, sf_dir), "l_quantity", "l_discount", "l_extendedprice")


@query(f"""WITH l AS (SELECT event_type AS k, round(value / 20, 1) AS b FROM events), c AS (SELECT k, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b) AS r, count(*) OVER (PARTITION BY k) AS m FROM c),
x AS (SELECT k, b, r, m, CASE WHEN r = m - 1 THEN n + lead(n) OVER (PARTITION BY k ORDER BY b) ELSE n END AS n FROM r), y AS (SELECT * FROM x WHERE r < m), p AS (SELECT k, arg_min(b, (-n, b)) AS peak, max(n) AS top FROM y GROUP BY k)
SELECT k, {R('peak')} AS peak, top AS n FROM p""")
def lag_peaks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), F.round(F.col("value") / 20, 1).alias("lag"))
    n = d.groupBy("k", "lag").agg(F.count("*").alias("n"))
    last = n.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("lag")))).where("_r = 1").select("k", F.col("lag").alias("last"), F.col("n").alias("last_n"))
    peaks = shapes.lag_ranges(d, ["k"], "lag", start=-1e9, stop=1e9).select("k", "peak")
    out = peaks.join(n.withColumnRenamed("lag", "peak"), ["k", "peak"]).join(last, "k")
    before = n.join(last, "k").where("lag < last").groupBy("k").agg(F.max("lag").alias("before"))
    return out.join(before, "k").select("k", "peak", F.when(F.col("peak") == F.col("before"), F.col("n") + F.col("last_n")).otherwise(F.col("n")).alias("n"))


@query()
def lag_ranges(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), F.round(F.col("value") / 20, 1).alias("lag"))
    return shapes.lag_ranges(d, ["k"], "lag")


@query(f"""WITH {cte()}, c AS (SELECT k, ts, v, CASE WHEN v > 60 THEN 60 ELSE v END AS a FROM s), d AS (SELECT k, ts, CASE WHEN a < 2 THEN 2 ELSE a END AS b FROM c), e AS (SELECT k, ts, CASE WHEN ts BETWEEN '2024-01-05' AND '2024-01-06' THEN 7 ELSE b END AS c FROM d)
SELECT k, ts, {R('CASE WHEN c <> 60 THEN c END')} AS v FROM e""")
def corrections_in_order(spark, sf_dir):
    steps = [{"key": "setto_max", "threshold": 60.0}, {"key": "setto_min", "threshold": 2.0}, {"key": "setto_value", "ranges": [("2024-01-05", "2024-01-06")], "value": 7.0}, {"key": "set_exact_to_missing", "values": [60.0]}]
    return corrections.apply_all(series(spark, sf_dir), ["k"], steps)


@query("""WITH e AS (SELECT event_type AS k, event_id, value AS v FROM events), a AS (SELECT *, v > 60 AS x FROM e), b AS (SELECT *, coalesce(v < 2 AND NOT x, false) AS y FROM a)
SELECT k, event_id, CASE WHEN x THEN 2 ELSE 0 END AS first, CASE WHEN x THEN NULL WHEN y THEN 2 ELSE 0 END AS second, CASE WHEN x OR y THEN 2 ELSE 0 END AS qcf FROM b""")
def stepwise_screening(spark, sf_dir):
    from aeolith.operators import outliers

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("v"))
    test = lambda lo, hi: lambda d, c, name: d.withColumn(name, outliers.absolute_limits(c, lo, hi))
    s = screening.Screening.of(e, ["k"], "v").try_("ABSLIM", test(-1e9, 60)).keep().try_("ABSLIM", test(2, 1e9)).keep()
    return s.overall().select("k", "event_id", F.col(s.flags[0]).alias("first"), F.col(s.flags[1]).alias("second"), "qcf")


@query(f"""{S}, p AS (SELECT k, ts, v, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 1 ELSE 0 END AS day FROM s) SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN abs(v - avg(v) OVER (PARTITION BY k, day)) / nullif(stddev_pop(v) OVER (PARTITION BY k, day), 0) > CASE day WHEN 1 THEN 2.0 ELSE 2.5 END THEN 2 ELSE 0 END AS flag FROM p""")
def zscore_by_day_and_night(spark, sf_dir):
    from aeolith.operators import outliers

    d = series(spark, sf_dir).withColumn("day", F.when(F.hour("ts").between(6, 17), 1).otherwise(0))
    at = lambda t: lambda x, name: outliers.zscore(x, ["k"], t, name=name)
    return screening.by_day_and_night(d, "day", at(2.5), at(2.0)).select("k", "ts", "flag")


@query()
def local_outliers_by_day_and_night(spark, sf_dir):
    d = series(spark, sf_dir).withColumn("day", F.when(F.hour("ts").between(6, 17), 1).otherwise(0))
    return screening.by_day_and_night(d, "day", lambda x, name: screening.lof_flag(x, ["k"], 20, 0.02, name=name)).select("k", "ts", "flag")


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 3 AS ssitc, 17000 + l_suppkey % 1000 AS found, 18000 AS expected, 1 + l_quantity / 10 AS scf FROM lineitem),
f AS (SELECT k, n, ssitc AS a, CASE WHEN found / expected >= 0.99 THEN 0 WHEN found / expected >= 0.97 THEN 1 ELSE 2 END AS b, CASE WHEN scf < 2 THEN 0 WHEN scf < 4 THEN 1 ELSE 2 END AS c FROM c), t AS (SELECT *, (a = 1)::INT + (b = 1)::INT + (c = 1)::INT AS soft, (a = 2)::INT + (b = 2)::INT + (c = 2)::INT AS hard FROM f)
SELECT k, n, a::INT AS ssitc, b AS completeness, c AS scf, CASE WHEN soft + hard = 0 THEN 0 WHEN hard > 0 THEN 2 ELSE 1 END AS qcf FROM t""")
def flux_test_bundle(spark, sf_dir):
    d = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.lit(1.0).alias("FC"), (F.col("l_partkey") % 3).alias("FC_SSITC_TEST"), (17000 + F.col("l_suppkey") % 1000).alias("CO2_NR"), F.lit(18000).alias("EXPECT_NR"), (1 + F.col("l_quantity") / 10).alias("FC_SCF"))
    out = screening.flux_flags(d, "FC")
    return out.select("k", "n", F.col("FLAG_L2_FC_SSITC_TEST").alias("ssitc"), F.col("FLAG_L2_FC_COMPLETENESS_TEST").alias("completeness"), F.col("FLAG_L2_FC_SCF_TEST").alias("scf"), F.col("FLAG_L2_FC_QCF").alias("qcf"))


@query(f"""WITH {cte()}, d AS (SELECT k, ts, v, date_diff('second', lag(ts) OVER o, ts) AS a, date_diff('second', ts, lead(ts) OVER o) AS z FROM s WHERE ts >= '2024-01-10' OR minute(ts) IN (0, 30) WINDOW o AS (PARTITION BY k ORDER BY ts)),
u AS (SELECT k, ts - to_seconds(i * 600) AS ts, v, coalesce(a, z) AS step FROM d, (SELECT unnest([0, 1, 2]) AS i) WHERE i * 600 < coalesce(a, z)) SELECT k, ts, {R('v')} AS v FROM u QUALIFY row_number() OVER (PARTITION BY k, ts ORDER BY step) = 1""")
def harmonised_resolution(spark, sf_dir):
    s = series(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) | F.minute("ts").isin(0, 30))
    return screening.harmonised(s, ["k"])


@query()
def highest_quality_flux(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("day", (F.col("swin") > 20).cast("int")).withColumnRenamed("flux", "v")
    return screening.highest_quality(d, ["k"], "day").select("k", "ts", "flag", "filtered", "median", "sd")


@query(f"""{H}, d AS (SELECT k, ts, ({TA})::DOUBLE AS ta, CASE WHEN {SWIN} >= 20 THEN 1 ELSE 0 END AS day, 1 + ustar * 5 AS u, 100 / (1 + ustar) AS ra FROM h),
t AS (SELECT *, CASE day WHEN 1 THEN 0.93 * ta + 3.17 ELSE 1.05 * ta + 1.52 END AS j, 0.0025 * ta * ta + 0.9 * ta + 2.07 AS b, 0.02425 + 0.00007 * ta AS kk FROM d),
l AS (SELECT *, 0.0028 * sqrt(0.045 / u) + 0.00025 / u + 0.0045 AS lt, 0.004 * sqrt(0.065 / u) + 0.004 AS lb, 0.0058 * sqrt(0.005 / u) AS ls FROM t),
w AS (SELECT *, kk * (0.0225 + lt) * (CASE day WHEN 1 THEN 1.005 * ta + 0.24 ELSE 1.008 * ta - 0.41 END - ta) / (0.0225 * lt) + kk * (CASE day WHEN 1 THEN 0.944 * ta + 2.57 ELSE 0.883 * ta + 2.17 END - ta) / lb
  + 0.15 * kk * (1.01 * ta + CASE day WHEN 1 THEN 0.36 ELSE -0.17 END - ta) / (0.0025 * ln((0.0025 + ls) / 0.0025)) AS heat FROM l)
SELECT k, ts, {R('(j - ta) * 15000 / (ra * (ta + 273.15)) * (1 + 1.6077 * 0.01 / 1.19)')} AS jar09, {R('(b - ta) * 15000 / (ra * (ta + 273.15)) * (1 + 1.6077 * 0.01 / 1.19)')} AS bur06, {R('heat / (1.2 * 1005) * 15000 / (ta + 273.15) * (1 + 1.6077 * 0.01 / 1.19)')} AS bur08 FROM w""")
def self_heating(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumns({"gas": F.lit(15000.0), "rho_a": F.lit(1.2), "rho_v": F.lit(0.01), "rho_d": F.lit(1.19), "c_p": F.lit(1005.0), "u": 1 + F.col("ustar") * 5, "ra": 100 / (1 + F.col("ustar")), "daytime": (F.col("swin") >= 20).cast("int")})
    return d.select("k", "ts", *[selfheating.unscaled_correction(m).alias(m.lower()) for m in ("JAR09", "BUR06", "BUR08")])


def _heated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = halfhours(spark, sf_dir).withColumns({"daytime": (F.col("swin") >= 20).cast("int"), "class_var": F.when(F.minute("ts") > 0, F.col("ustar")).otherwise(F.when(F.hour("ts") != 3, F.col("ustar"))), "correction": 0.5 + F.col("ta") / 100})
    return d.withColumn("reference", F.col("flux") + F.col("correction") * (1 + 2 * F.col("ustar")))


@query()
def self_heating_factors(spark, sf_dir):
    return selfheating.scaling_factors(_heated(spark, sf_dir), ["k"], 5, 10, least=5)


@query()
def self_heating_applied(spark, sf_dir):
    d = _heated(spark, sf_dir)
    return selfheating.apply_scaling(d, selfheating.scaling_factors(d, ["k"], 5, least=5), ["k"]).select("k", "ts", "class", "factor", "corrected", "corrected_flag")


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours whose exchange follows known curves of temperature and radiation, less gaps; the events only set where values are missing."""
    d = halfhours(spark, sf_dir)
    nee = 2.5 * F.exp(200 * (1 / 61.02 - 1 / (F.col("ta") + 46.02))) - 0.04 * 25 * F.col("swin") / (0.04 * F.col("swin") + 25)
    return d.withColumns({"nee": F.when(F.col("flux").isNotNull(), nee), "nee_f": nee, "ta_f": F.col("ta"), "sw_in": F.col("swin"), "sw_in_f": F.col("swin")}).drop("flux", "swin", "ustar")


@query()
def nighttime_whole_record(spark, sf_dir):
    return partition.nighttime_whole_record(_net(spark, sf_dir), ["k"], LAT, LON, OFFSET).select("k", "ts", "e0", "reco", "gpp")


@query()
def daytime_partitioning(spark, sf_dir):
    return partition.daytime(_net(spark, sf_dir), ["k"], False).select("k", "ts", "reco_dt", "gpp_dt")


@query()
def daytime_partitioning_smooth(spark, sf_dir):
    return partition.daytime(_net(spark, sf_dir), ["k"], False, smooth=True).select("k", "ts", "reco_dt", "gpp_dt")


@query()
def ustar_quantile_detection(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("nee", F.col("flux"))
    return flux.ustar_percentiles(flux.detect_ustar_quantiles(d.select("k", "ts", "nee", "ta", "ustar", "swin"), ["k"], 20, swin="swin"), ["k"])


@query(f"""{H}, u AS (SELECT k, year(ts) AS y, 0.1 + min(ustar) AS t FROM h GROUP BY 1, 2) SELECT h.k, ts, CASE WHEN flux IS NULL THEN NULL WHEN ustar >= t THEN 0 ELSE 2 END AS flag FROM h JOIN u ON h.k = u.k AND year(ts) = y""")
def ustar_filter_by_year(spark, sf_dir):
    d = halfhours(spark, sf_dir)
    t = d.groupBy("k", F.year("ts").alias("year")).agg((F.min("ustar") + 0.1).alias("threshold"))
    return flux.ustar_flag_by_record(d, ["k"], "flux", t).select("k", "ts", "flag")


@query()
def flux_chain_scenarios(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("storage", F.col("ta") / 20)
    c = flux.run_chain(d, flux.Site(LAT, LON, OFFSET), ["k"], flux.Config("flux", storage="storage", outlier_size=96, thresholds={"CUT_16": 0.1, "CUT_84": 0.2}))
    return c.df.select("k", "ts", "flux_l33_CUT_16", "flux_l33_CUT_84", "flux_l41_CUT_16", "reco_CUT_84", "gpp_CUT_84")


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily orders of all years with a gap in each month, and two drivers."""
    return daily_orders(spark, sf_dir).withColumns({"target": F.when(F.dayofmonth("ts") != 13, F.col("v")), "a": F.sin(F.dayofyear("ts") / 58.0), "b": F.col("n").cast("double")}).select("ts", "target", "a", "b")


@query()
def yearly_model_pools(spark, sf_dir):
    return longterm.fill_yearly(_years(spark, sf_dir), "target", ["a", "b"]).df.select("ts", "filled", "fill_flag")


@query()
def feature_selection(spark, sf_dir):
    return longterm.select_features(_years(spark, sf_dir).dropna(), "target", ["a", "b"])[1].select("driver", "rank")


@query()
def radiation_filling(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("potential", F.col("swin") * 1.3).withColumn("v", F.when(F.col("flux").isNotNull(), F.col("swin") * 0.9))
    return longterm.fill_radiation(d.select("k", "ts", "potential", "v"), ["k"]).select("k", "ts", "filled", "fill_flag")


def _analysis(spark: SparkSession, sf_dir: str) -> drivers.Drivers:
    d = lines(spark, sf_dir).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").cast("double").alias("quantity"), "l_discount", "l_tax", F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.lit("a").alias("k"), "l_returnflag")
    return drivers.Drivers(d, "y", ["quantity", "l_discount", "l_tax"])


@query()
def driver_importance(spark, sf_dir):
    return _analysis(spark, sf_dir).shap().result.tables["shap"].select("driver", "rank", "relevant")


@query()
def local_effects(spark, sf_dir):
    return _analysis(spark, sf_dir).fit().effects("quantity", 10)


@query()
def local_effects_2d(spark, sf_dir):
    return _analysis(spark, sf_dir).fit().effects_2d("quantity", "l_discount", 5)


@query(f"""{S}, d AS (SELECT k, ts, v, {TA} AS t FROM s), p AS (SELECT k, CAST(ts AS DATE) AS day, count(*) AS n, round(corr(v, t), 9) AS r FROM d WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2)
SELECT k, day, {R('r')} AS r, row_number() OVER (PARTITION BY k ORDER BY abs(r) DESC, day)::INT AS rank FROM p WHERE isfinite(r) QUALIFY rank <= 5""")
def days_of_high_correlation(spark, sf_dir):
    h = F.hour("ts") + F.minute("ts") / 60
    import math

    d = series(spark, sf_dir).withColumn("t", 10 + 8 * F.sin((h - 9) * math.pi / 12) + F.dayofyear("ts") / 30)
    days = stats.daily_correlation(d, ["k"], "v", "t").where("n > 2 AND r IS NOT NULL").withColumn("r", F.round("r", 9))
    return stats.days_by_correlation(days).where("rank <= 5").select("k", "day", "r", "rank")


@query(f"""{S}, d AS (SELECT k, ts, v, {TA} AS t FROM s), p AS (SELECT k, CAST(ts AS DATE) AS day, corr(v, t) AS r FROM d WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2), z AS (SELECT k, day, r, abs(r - avg(r) OVER (PARTITION BY k)) / stddev_samp(r) OVER (PARTITION BY k) AS score FROM p WHERE isfinite(r))
SELECT k, day, {R('score')} AS score FROM z WHERE score > 1""")
def unusual_correlation_days(spark, sf_dir):
    h = F.hour("ts") + F.minute("ts") / 60
    import math

    d = series(spark, sf_dir).withColumn("t", 10 + 8 * F.sin((h - 9) * math.pi / 12) + F.dayofyear("ts") / 30)
    days = stats.daily_correlation(d, ["k"], "v", "t").where("n > 2")
    return stats.unusual_days(days, ["k"], 1.0).select("k", "day", "score")


@query(f"""{S}, i AS (SELECT k, ts, v, sum((v IS NOT NULL)::INT) OVER (PARTITION BY k ORDER BY ts) AS g FROM s), p AS (SELECT k, g, min(ts) AS a, max(ts) AS z, count(*) AS n FROM i WHERE v IS NULL GROUP BY 1, 2),
d AS (SELECT *, greatest(date_diff('second', TIMESTAMP '2024-01-12 12:00:00', a), date_diff('second', z, TIMESTAMP '2024-01-12 12:00:00'), 0) AS away FROM p) SELECT k, a AS gap_start, z AS gap_end, n AS length FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY away, a) = 1""")
def gap_nearest(spark, sf_dir):
    return gaps.gap_at(gaps.find_gaps(series(spark, sf_dir), ["k"]), ["k"], "2024-01-12 12:00:00").select("k", "gap_start", "gap_end", "length")


@query(f"""{D}, w AS (SELECT ts, v, row_number() OVER (ORDER BY ts) - 1 AS r, CASE WHEN count(v) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN sum(v) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS t FROM s), p AS (SELECT *, avg(v - t) OVER (PARTITION BY r % 7) AS p FROM w), c AS (SELECT avg(p) AS c FROM (SELECT DISTINCT r % 7 AS m, p FROM p))
SELECT ts, {R('t + p - c')} AS reconstructed FROM p, c""")
def reconstructed_signal(spark, sf_dir):
    return decompose.reconstruct(decompose.classical(daily(spark, sf_dir).select("k", "ts", "v"), ["k"], 7), ("trend", "seasonal")).select("ts", "reconstructed")


@query(f"""{H}, d AS (SELECT k, ts, {SWIN} - 3 AS v, NOT ({SWIN} >= 20) AS night FROM h), o AS (SELECT *, avg(v) FILTER (night) OVER (PARTITION BY k, CAST(ts AS DATE)) AS o FROM d), m AS (SELECT *, coalesce(o, median(o) OVER (PARTITION BY k)) AS q FROM o)
SELECT k, count_if(night) AS n_night, count_if(v < 0) AS below_before, count_if(v < 0 AND night) AS below_before_night, count_if(v - q < -1e-9) AS below_after, count_if(v - q < -1e-9 AND night) AS below_after_night FROM m GROUP BY k""")
def night_offset_report(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("v", F.round(F.col("swin") - 3, 9))
    night = ~(F.col("swin") >= 20)
    return corrections.night_offset_report(d.withColumn("v", F.col("v")), ["k"], night).withColumn("below_after", F.col("below_after")).select("k", "n_night", "below_before", "below_before_night", "below_after", "below_after_night")


@query(f"""{S} SELECT strftime(ts - INTERVAL '10 minutes', '%Y%m%d%H%M') AS "TIMESTAMP_START", strftime(ts, '%Y%m%d%H%M') AS "TIMESTAMP_END", k, {R('coalesce(v, -9999)')} AS "TA_1" FROM s""")
def upload_layout(spark, sf_dir):
    s = series(spark, sf_dir)
    kinds = [r[0] for r in s.select("k").distinct().orderBy("k").collect()]
    parts = [formats.for_upload(s.where(F.col("k") == k), {"v": "TA_1"}, 600.0).withColumn("k", F.lit(k)) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {cte()}, d AS (SELECT k, ts, date_diff('second', lag(ts) OVER o, ts) AS step, row_number() OVER o AS a, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS z FROM s WHERE NOT (ts BETWEEN '2024-01-06' AND '2024-01-07') WINDOW o AS (PARTITION BY k ORDER BY ts)),
e AS (SELECT k, count(*) AS n, any_value(step) FILTER (a = 2) AS f, any_value(step) FILTER (z = 1) AS l FROM d GROUP BY k), r AS (SELECT d.k, any_value(n) AS n, any_value(f) AS f, any_value(l) AS l, min(a) FILTER (a > 1 AND step <> f) - 1 AS x, min(z) FILTER (a > 1 AND step <> l) AS y FROM d JOIN e USING (k) GROUP BY 1),
t AS (SELECT k, f, f = l AS same, least(1000, n // 2, coalesce(x, 1000), coalesce(y, 1000))::INT AS n FROM r) SELECT k, CASE WHEN same AND n >= 4 THEN {R('f')} END AS step, CASE WHEN same AND n >= 4 THEN n END AS n FROM t""")
def frequency_of_ends(spark, sf_dir):
    d = series(spark, sf_dir).where(~F.col("ts").between(F.lit("2024-01-06").cast("timestamp_ntz"), F.lit("2024-01-07").cast("timestamp_ntz")))
    return timeaxis.frequency_of_ends(d, ["k"]).withColumn("step", F.col("step").cast("double"))


@query("""WITH e AS (SELECT event_type AS k, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r FROM events)
SELECT k, event_id, TIMESTAMP '2024-01-01' + to_microseconds((round_even(r * CASE WHEN n = 36000 THEN 0.05 ELSE 1800.0::DOUBLE / n END / 0.05, 0) * 50000)::BIGINT) AS ts FROM e""")
def stamps_by_number(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), "event_id")
    return timeaxis.stamps_by_number(e, ["k"], "event_id", "2024-01-01", 0.05, 1800.0)


@query()
def made_series(spark, sf_dir):
    return columns.made_series(spark)


@query()
def fill_quality_breakdown(spark, sf_dir):
    return fill.quality_breakdown(fill.mds(halfhours(spark, sf_dir), ["k"]), ["k"])


@query()
def uncertainty_cascade(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("filled", F.coalesce("flux", F.col("ta")))
    return flux.uncertainty_cascade(d, ["k"]).select("k", "ts", "uncertainty", "method")


@query(f"""{H}, d AS (SELECT k, ts, dayofyear(ts) AS n, {HH} AS h, 2 * pi() * (dayofyear(ts) - 1) / 365.0 AS g, {SWIN} AS v FROM h), p AS (SELECT k, CAST(ts AS DATE) AS day, v, greatest(1367.0 * (1 + 0.033 * cos(2 * pi() * n / 365.0)) * (sin(radians({LAT})) * sin({DEC}) + cos(radians({LAT})) * cos({DEC}) * cos(radians(15 * (h + ({EOT} + 4 * ({LON} - 15 * {OFFSET})) / 60 - 12)))), 0) AS p FROM d)
SELECT k, day, count(*) AS n, {R('CASE WHEN count(*) > 1 AND stddev_pop(v) > 0 AND stddev_pop(p) > 0 THEN covar_pop(v, p) / (stddev_pop(v) * stddev_pop(p)) END')} AS r FROM p GROUP BY 1, 2""")
def radiation_correlation(spark, sf_dir):
    return screening.radiation_days(halfhours(spark, sf_dir), ["k"], LAT, LON, OFFSET, "swin")


@query(f"""WITH e AS (SELECT event_type AS k, ts, CASE WHEN value BETWEEN 2 AND 60 THEN value END AS v FROM events), b AS (SELECT k, time_bucket(INTERVAL '1 hour', ts) AS w, avg(v) AS x, count(v) AS n FROM e GROUP BY 1, 2), l AS (SELECT *, floor(max(n) OVER (PARTITION BY k) * 0.25) AS least FROM b),
x AS (SELECT k, w + INTERVAL '1 hour' AS ts, CASE WHEN n >= CASE WHEN least < 3 THEN 1 ELSE least END THEN x END AS v FROM l), r AS (SELECT k, min(ts) AS a, max(ts) AS z FROM x GROUP BY k), g AS (SELECT k, unnest(generate_series(a, z, INTERVAL '1 hour')) AS ts FROM r)
SELECT g.k, g.ts, {R('v')} AS v, 'hourly' AS freq FROM g LEFT JOIN x ON g.k = x.k AND g.ts = x.ts""")
def screened_and_resampled(spark, sf_dir):
    from aeolith.operators import outliers

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("v"))
    s = screening.Screening.of(e, ["k"], "v").try_("ABSLIM", lambda d, c, name: d.withColumn(name, outliers.absolute_limits(c, 2, 60))).keep()
    return screening.finished(s, 3600, tags={"freq": "hourly"})
