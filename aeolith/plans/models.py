"""Queries of radiation, gap filling, decomposition and flux processing over series made from ``events``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.functions import solar
from aeolith.operators import decompose, fill, flux, quality, shifts, stats
from aeolith.plans.frames import D, daily_orders
from aeolith.plans.registry import query
from aeolith.plans.series import R, cte, events, series
from aeolith.sources import files

LAT, LON, OFFSET = 47.3, 7.7, 1.0


def halfhours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly means by event type with made-up drivers that follow the stamp: radiation, temperature, deficit, friction velocity."""
    s = series(spark, sf_dir, 1800)
    h = F.hour("ts") + F.minute("ts") / 60
    return s.withColumns({
        "swin": F.greatest(F.lit(0.0), 500 * F.sin((h - 6) * math.pi / 12)), "ta": 10 + 8 * F.sin((h - 9) * math.pi / 12) + F.dayofyear("ts") / 30,
        "vpd": 5 + 4 * F.sin((h - 9) * math.pi / 12), "ustar": F.pmod(F.dayofyear("ts") * 7 + F.hour("ts") * 13 + F.minute("ts"), F.lit(50)) / 100,
    }).withColumnRenamed("v", "flux")


H = f"""WITH {cte('30 minutes')}, h AS (SELECT k, ts, v AS flux, ((dayofyear(ts) * 7 + hour(ts) * 13 + minute(ts)) % 50) / 100 AS ustar FROM s)"""

DEC = "(0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g))"
EOT = "(229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)))"


@query(f"""WITH t AS (SELECT event_id, dayofyear(ts) AS n, hour(ts) + minute(ts) / 60 AS h, 2 * pi() * (dayofyear(ts) - 1) / 365.0 AS g FROM events),
p AS (SELECT event_id, greatest(1367.0 * (1 + 0.033 * cos(2 * pi() * n / 365.0)) * (sin(radians({LAT})) * sin({DEC}) + cos(radians({LAT})) * cos({DEC}) * cos(radians(15 * (h + ({EOT} + 4 * ({LON} - 15 * {OFFSET})) / 60 - 12)))), 0) AS p FROM t)
SELECT event_id, {R('p')} AS potential, CASE WHEN p >= 20 THEN 1 ELSE 0 END AS daytime FROM p""")
def potential_radiation(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    p = solar.potential_radiation(F.dayofyear("ts"), F.hour("ts") + F.minute("ts") / 60, LAT, LON, OFFSET)
    return e.select("event_id", p.alias("potential")).withColumn("daytime", solar.daytime(F.col("potential")))


@query(f"""WITH {cte('30 minutes')}, t AS (SELECT k, ts, dayofyear(ts) AS n, 2 * pi() * (dayofyear(ts) - 1) / 365.0 AS g, hour(ts) * 60 + minute(ts) + second(ts) / 60 AS m, unnest(range(30)) AS i FROM s), u AS (SELECT *, (m - 15 + i + 0.5) / 60 AS h FROM t),
p AS (SELECT k, ts, greatest(1367.0 * (1 + 0.033 * cos(2 * pi() * n / 365.0)) * (sin(radians({LAT})) * sin({DEC}) + cos(radians({LAT})) * cos({DEC}) * cos(radians(15 * (h + ({EOT} + 4 * ({LON} - 15 * {OFFSET})) / 60 - 12)))), 0) AS p FROM u)
SELECT k, ts, {R('avg(p)')} AS potential FROM p GROUP BY 1, 2""")
def mean_potential_radiation(spark, sf_dir):
    return series(spark, sf_dir, 1800).select("k", "ts", solar.mean_potential_radiation(F.col("ts"), 30, LAT, LON, OFFSET).alias("potential"))


@query(f"""{H} SELECT k, ts, CASE WHEN flux IS NULL THEN NULL WHEN ustar >= 0.2 THEN 0 ELSE 2 END AS flag, {R('CASE WHEN NOT ustar < 0.2 THEN flux END')} AS scenario FROM h""")
def ustar_filter(spark, sf_dir):
    return halfhours(spark, sf_dir).select("k", "ts", flux.ustar_flag(F.col("flux"), F.col("ustar"), 0.2).alias("flag"), flux.ustar_scenario(F.col("flux"), F.col("ustar"), 0.2).alias("scenario"))


@query()
def ustar_detection(spark, sf_dir):
    d = halfhours(spark, sf_dir).where("swin < 10").withColumn("nee", F.col("flux"))
    return flux.ustar_percentiles(flux.detect_ustar(d.select("k", "ts", "nee", "ta", "ustar"), ["k"], 100), ["k"])


STORAGE_FILL = ", ".join(f"CASE WHEN count(st) OVER w{n} >= 3 THEN median(st) OVER w{n} END" for n in (3, 5, 9, 17, 33, 65, 97))
STORAGE_WINDOWS = ", ".join(f"w{n} AS (PARTITION BY k ORDER BY ts ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)" for n in (3, 5, 9, 17, 33, 65, 97))
TA_SQL, SWIN_SQL, VPD_SQL = ("(10 + 8 * sin((hh - 9) * pi() / 12) + dayofyear(ts) / 30)", "greatest(0.0, 500 * sin((hh - 6) * pi() / 12))", "(5 + 4 * sin((hh - 9) * pi() / 12))")


@query(f"""{H}, x AS (SELECT k, ts, flux, hour(ts) + minute(ts) / 60 AS hh FROM h), t AS (SELECT k, ts, flux, CASE WHEN hour(ts) % 5 > 1 THEN {TA_SQL} / 10 END AS st FROM x), f AS (SELECT k, ts, flux, st, coalesce(st, {STORAGE_FILL}, 0.0) AS filled FROM t WINDOW {STORAGE_WINDOWS})
SELECT k, ts, {R('filled')} AS storage_filled, {R('flux + filled')} AS corrected, CASE WHEN st IS NOT NULL THEN 0 ELSE 1 END AS storage_flag FROM f""")
def storage_correction(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("storage", F.when(F.pmod(F.hour("ts"), F.lit(5)) > 1, F.col("ta") / 10))
    return flux.storage_corrected(d, ["k"], "flux", "storage").select("k", "ts", "storage_filled", "corrected", "storage_flag")


@query()
def mds_gap_filling(spark, sf_dir):
    return fill.mds(halfhours(spark, sf_dir), ["k"]).select("k", "ts", "filled", "sd", "n", "method", "window")


@query(f"""{H}, x AS (SELECT k, ts, flux, hour(ts) + minute(ts) / 60 AS hh FROM h), d AS (SELECT k, ts, flux, epoch(ts)::BIGINT // 86400 AS day, hour(ts) * 60 + minute(ts) AS mm, {TA_SQL} AS ta, {SWIN_SQL} AS sw, {VPD_SQL} AS vpd FROM x),
u AS (SELECT g.k, g.ts, stddev_samp(m.flux) AS sd, count(*) AS n FROM d g JOIN d m ON g.k = m.k AND abs(g.day - m.day) <= 7 AND least(abs(g.mm - m.mm), 1440 - abs(g.mm - m.mm)) <= 60 AND abs(g.ta - m.ta) <= 2.5 AND abs(g.vpd - m.vpd) <= 5.0 AND abs(g.sw - m.sw) <= least(greatest(g.sw, 20.0), 50.0)
WHERE g.flux IS NOT NULL AND m.flux IS NOT NULL GROUP BY 1, 2) SELECT d.k, d.ts, {R('CASE WHEN n >= 6 THEN sd END')} AS uncertainty FROM d LEFT JOIN u ON d.k = u.k AND d.ts = u.ts""")
def random_uncertainty(spark, sf_dir):
    return flux.random_uncertainty(halfhours(spark, sf_dir), ["k"]).select("k", "ts", "uncertainty")


@query()
def tree_gap_filling(spark, sf_dir):
    return fill.by_trees(halfhours(spark, sf_dir), ["k"], "flux", ["swin", "ta", "vpd"])[0].select("k", "ts", "filled", "fill_flag")


@query()
def nighttime_partitioning(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumns({"nee": F.col("flux"), "nee_f": F.coalesce("flux", F.lit(0.0)), "ta_f": F.col("ta"), "sw_in": F.col("swin")})
    return flux.partition_nighttime(d.select("k", "ts", "nee", "ta", "sw_in", "nee_f", "ta_f"), ["k"]).select("k", "ts", "reco", "gpp")


@query(f"""{D}, w AS (SELECT ts, v, row_number() OVER (ORDER BY ts) - 1 AS r, CASE WHEN count(v) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN sum(v) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS t FROM s),
p AS (SELECT *, avg(v - t) OVER (PARTITION BY r % 7) AS p FROM w), c AS (SELECT avg(p) AS c FROM (SELECT DISTINCT r % 7 AS m, p FROM p))
SELECT ts, {R('v')} AS v, {R('t')} AS trend, {R('p - c')} AS seasonal, {R('v - t - (p - c)')} AS residual FROM p, c""")
def classical_decomposition(spark, sf_dir):
    d = daily_orders(spark, sf_dir).select(F.lit("a").alias("k"), "ts", "v")
    return decompose.classical(d, ["k"], 7).drop("k")


@query(f"""{D}, x AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS r, v - avg(v) OVER () AS x FROM s), h AS (SELECT k, 2 * avg(x * cos(2 * pi() * k * r / 365)) AS a, 2 * avg(x * sin(2 * pi() * k * r / 365)) AS b FROM x, (SELECT unnest([1, 2, 3])::INT AS k) GROUP BY k)
SELECT k AS harmonic, round(sqrt(a * a + b * b), 3) + 0.0 AS amplitude, round(atan2(b, a), 5) + 0.0 AS phase FROM h""")
def harmonic_analysis(spark, sf_dir):
    d = daily_orders(spark, sf_dir).select(F.lit("a").alias("k"), "ts", "v")
    return decompose.harmonics(d, ["k"], 365, 3).select("harmonic", (F.round("amplitude", 3) + 0.0).alias("amplitude"), (F.round("phase", 5) + 0.0).alias("phase"))


@query()
def stl_decomposition(spark, sf_dir):
    return decompose.stl(daily_orders(spark, sf_dir).select(F.lit("a").alias("k"), "ts", "v"), ["k"], 7, 35).drop("k")


@query()
def seasonality_detection(spark, sf_dir):
    return decompose.seasonality(series(spark, sf_dir, 1800), ["k"], 400)


@query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS p, o_orderstatus AS s FROM orders), b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS p, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, (round(coalesce(a.p, b.p), 2) + 0.0) AS p, s, n FROM a FULL JOIN b ON a.k = b.k""")
def combine_first(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("p"), F.col("o_orderstatus").alias("s"))
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("p"), F.count("*").alias("n"))
    return files.combine_first([a, b], ["k"]).withColumn("p", F.round("p", 2) + 0.0)


@query()
def flux_chain(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("raw_flag", F.when(F.col("flux") > 150, 2).otherwise(0)).withColumn("storage", F.col("ta") / 20)
    c = flux.Chain(d, flux.Site(LAT, LON, OFFSET), ["k"], "flux").level0().level2([F.col("raw_flag")]).level31("storage").level32(96, 5.5).level33(0.1).level41().level42()
    return c.df.select("k", "ts", "sw_in_pot", "qcf_l2", "flux_l33", "flux_l41", "reco", "gpp")


@query(f"""{H}, d AS (SELECT k, ts, greatest(0, 500 * sin(((hour(ts) + minute(ts) / 60) - 6) * pi() / 12)) AS p, 2 * pi() / 1440 * (hour(ts) * 60 + minute(ts)) AS a FROM h), m AS (SELECT *, lag(p, 2) OVER (PARTITION BY k ORDER BY ts) AS m FROM d),
f AS (SELECT k, CAST(ts AS DATE) AS day, count(m) / count(*) AS share, sum(m) / sum(CASE WHEN m IS NOT NULL THEN p END) AS clear, atan2(sum(m * sin(a)), sum(m * cos(a))) - atan2(sum(p * sin(a)), sum(p * cos(a))) AS t FROM m GROUP BY 1, 2)
SELECT k, day, {R('(t - 2 * pi() * round(t / (2 * pi()))) * 1440 / (2 * pi())')} AS minutes FROM f WHERE share >= 0.9 AND clear >= 0.6""")
def clock_phase_shift(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("m", F.lag("swin", 2).over(Window.partitionBy("k").orderBy("ts")))
    return shifts.phase_shift(d, ["k"], "m", "swin")


@query(f"""{H}, x AS (SELECT k, ts, hour(ts) + minute(ts) / 60 AS hh FROM h), p AS (SELECT k, ts, {SWIN_SQL} AS p FROM x), m AS (SELECT *, lag(p, 2) OVER (PARTITION BY k ORDER BY ts) AS m FROM p),
l AS ({" UNION ALL ".join(f"SELECT k, ts, p, {j} AS lag, {'lead' if j >= 0 else 'lag'}(m, {abs(j)}) OVER (PARTITION BY k ORDER BY ts) AS x FROM m" for j in range(-4, 5))}), r AS (SELECT k, CAST(ts AS DATE) AS day, lag, round(corr(x, p), 9) AS r FROM l GROUP BY 1, 2, 3)
SELECT k, day, lag, {R('r')} AS r FROM r WHERE r IS NOT NULL AND isfinite(r) QUALIFY row_number() OVER (PARTITION BY k, day ORDER BY r DESC, abs(lag), lag DESC) = 1""")
def clock_lag_shift(spark, sf_dir):
    d = halfhours(spark, sf_dir).withColumn("m", F.lag("swin", 2).over(Window.partitionBy("k").orderBy("ts")))
    return shifts.lag_shift(d, ["k"], "m", "swin")


@query()
def wind_direction_offset(spark, sf_dir):
    d = daily_orders(spark, sf_dir).withColumn("wd", F.pmod(F.col("total") / 100 + F.when(F.year("ts") == 1997, 20).otherwise(0), F.lit(360.0)))
    return shifts.wind_direction_offset(d, "wd", [1995, 1996])


@query("""SELECT count(*) AS rows, 6 AS columns, count(*) * 6 AS cells, 0::BIGINT AS missing_cells, (round(0.0, 6) + 0.0) AS missing_percent, count(*) - count(DISTINCT o_orderdate) AS repeated_stamps, 0::BIGINT AS repeated_rows, min(o_orderdate)::TIMESTAMP AS start, max(o_orderdate)::TIMESTAMP AS "end" FROM orders""")
def frame_overview(spark, sf_dir):
    return stats.overview(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_orderdate").withColumn("missing_percent", F.coalesce("missing_percent", F.lit(0.0)).cast("double"))


@query("""SELECT DISTINCT unnest([o_orderstatus, o_orderpriority]) AS value FROM orders""")
def unique_values(spark, sf_dir):
    return stats.unique_values(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority"))


@query("""WITH e AS (SELECT event_type AS k, value AS v, value > 60 AS a, value < 5 OR value > 80 AS b, value BETWEEN 20 AND 30 AS c FROM events), t AS (SELECT k, 'a' AS test, 0 AS position, count_if(a)::BIGINT AS newly_rejected, count_if(NOT a)::BIGINT AS retained FROM e GROUP BY k
UNION ALL SELECT k, 'b', 1, count_if(b AND NOT a)::BIGINT, count_if(NOT a AND NOT b)::BIGINT FROM e GROUP BY k UNION ALL SELECT k, 'c', 2, count_if(c AND NOT a AND NOT b)::BIGINT, count_if(NOT a AND NOT b AND NOT c)::BIGINT FROM e GROUP BY k) SELECT * FROM t""")
def screening_report(spark, sf_dir):
    v = F.col("v")
    d = events(spark, sf_dir).withColumns({"a": F.when(v > 60, 2).otherwise(0), "b": F.when((v < 5) | (v > 80), 2).otherwise(0), "c": F.when(v.between(20, 30), 2).otherwise(0)})
    return quality.screening_report(d, "v", ["a", "b", "c"], ["k"])
