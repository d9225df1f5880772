"""Queries over series made from ``events``: ten-minute means for each event type on its full grid, gaps null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.functions import meteo
from aeolith.operators import binning, corrections, gaps, outliers, quality, resample, stats, timeaxis, windows
from aeolith.plans.registry import OFF_HALF, query

STEP = 600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("v"))


def series(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    """(k, ts, v): means by step, rounded to four places, on the grid."""
    e = events(spark, sf_dir)
    b = e.groupBy("k", F.window("ts", f"{step} seconds").alias("w")).agg(F.round(F.avg("v") + OFF_HALF, 4).alias("v"))
    return timeaxis.regularize(b.select("k", F.col("w.start").alias("ts"), "v"), ["k"], step)


def cte(step: str = "10 minutes") -> str:
    return f"""b_ AS (SELECT event_type AS k, time_bucket(INTERVAL '{step}', ts) AS ts, round(avg(value) + 1.3e-8, 4) AS v FROM events GROUP BY 1, 2),
r_ AS (SELECT k, min(ts) AS a, max(ts) AS z FROM b_ GROUP BY k),
g_ AS (SELECT k, unnest(generate_series(a, z, INTERVAL '{step}')) AS ts FROM r_),
s AS (SELECT g_.k, g_.ts, b_.v FROM g_ LEFT JOIN b_ USING (k, ts))"""


def R(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


S = f"WITH {cte()}"
Z = "abs(v - avg(v) OVER (PARTITION BY k)) / nullif(stddev_pop(v) OVER (PARTITION BY k), 0)"


@query(f"{S} SELECT k, ts, {R('v')} AS v FROM s")
def regularize_grid(spark, sf_dir):
    return series(spark, sf_dir)


@query("""WITH d AS (SELECT event_type AS k, date_diff('second', lag(date_trunc('hour', ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id), date_trunc('hour', ts)) AS step FROM events)
SELECT k, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2""")
def step_histogram(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    return timeaxis.steps(e.withColumn("ts", F.col("h")), ["k"])


@query(f"""{S}, d AS (SELECT k, date_diff('second', lag(ts) OVER (PARTITION BY k ORDER BY ts), ts) AS step FROM s WHERE v IS NOT NULL),
n AS (SELECT k, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2),
t AS (SELECT k, step, n, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, step) AS rn FROM n)
SELECT k, CASE WHEN n / total > 0.5 THEN step END AS step, {R('n / total')} AS share FROM t WHERE rn = 1""")
def detect_frequency(spark, sf_dir):
    return timeaxis.detect_frequency(series(spark, sf_dir).where("v IS NOT NULL"), ["k"])


@query("""WITH e AS (SELECT event_type AS k, date_trunc('minute', ts) AS ts, value AS v, event_id FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY event_id DESC) AS rn FROM e) SELECT k, ts, event_id, (round(v, 6) + 0.0) AS v FROM t WHERE rn = 1""")
def drop_duplicates_keep_last(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("MINUTE", "ts").cast("timestamp_ntz"))
    return timeaxis.drop_duplicate_stamps(e, ["k"], ["event_id"]).select("k", "ts", "event_id", "v")


@query("""WITH e AS (SELECT event_type AS k, date_trunc('minute', ts) AS ts, value AS v, event_id FROM events),
t AS (SELECT *, count(*) OVER (PARTITION BY k, ts) AS n FROM e) SELECT k, ts, event_id, (round(v, 6) + 0.0) AS v FROM t WHERE n = 1""")
def drop_duplicates_keep_none(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("MINUTE", "ts").cast("timestamp_ntz"))
    return timeaxis.drop_duplicate_stamps(e, ["k"], ["event_id"], "none").select("k", "ts", "event_id", "v")


@query("""WITH e AS (SELECT event_type AS k, date_trunc('hour', ts) AS ts, value AS v, event_id FROM events),
t AS (SELECT k, ts, max_by(v, event_id) AS v FROM e GROUP BY k, ts), r AS (SELECT k, min(ts) AS a, max(ts) AS z FROM t GROUP BY k),
g AS (SELECT k, unnest(generate_series(a, z, INTERVAL '1 hour')) AS ts FROM r)
SELECT g.k, g.ts - INTERVAL '30 minutes' AS ts, (round(v, 6) + 0.0) AS v FROM g LEFT JOIN t USING (k, ts)""")
def sanitize_timestamps(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    return timeaxis.sanitize(e, ["k"], ["event_id"], 3600, convention="END").select("k", "ts", "v")


@query("""SELECT event_id, ts - INTERVAL '300 seconds' AS start_ts, ts + INTERVAL '300 seconds' AS end_ts, ts + INTERVAL '5400 seconds' AS shifted, strftime(ts, '%Y%m%d%H%M') AS compact FROM events""")
def stamp_conventions(spark, sf_dir):
    t = F.col("ts")
    return events(spark, sf_dir).select("event_id", timeaxis.convert_convention(t, "MIDDLE", "START", STEP).alias("start_ts"), timeaxis.convert_convention(t, "MIDDLE", "END", STEP).alias("end_ts"), timeaxis.shift_hours(t, 1.5).alias("shifted"), F.date_format("ts", "yyyyMMddHHmm").alias("compact"))


@query("SELECT event_type AS k, count(*) AS n FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-12 06:00:00' GROUP BY 1")
def keep_date_range(spark, sf_dir):
    return timeaxis.keep_range(events(spark, sf_dir), "2024-01-05", "2024-01-12 06:00:00").groupBy("k").agg(F.count("*").alias("n"))


RESAMPLE = f"""{S}, w AS (SELECT k, time_bucket(INTERVAL '3 hours', ts) + INTERVAL '3 hours' AS ts, {{agg}}(v) AS x, count(v) AS n FROM s GROUP BY 1, 2),
m AS (SELECT *, floor(max(n) OVER (PARTITION BY k) * {{share}}) AS l FROM w),
f AS (SELECT k, ts, CASE WHEN n >= CASE WHEN l < 3 THEN 1 ELSE l END THEN x END AS v FROM m)
SELECT k, ts, {R('v')} AS v FROM f"""


@query(RESAMPLE.format(agg="avg", share=0.5))
def resample_mean(spark, sf_dir):
    return resample.resample(series(spark, sf_dir), ["k"], 10800, "avg", 0.5)


@query(RESAMPLE.format(agg="sum", share=0.9))
def resample_sum(spark, sf_dir):
    return resample.resample(series(spark, sf_dir), ["k"], 10800, "sum", 0.9)


@query(f"""{S}, d AS (SELECT k, CAST(ts AS DATE) AS day, avg(v) AS v, count(v) AS n FROM s GROUP BY 1, 2), m AS (SELECT *, greatest(1, floor(max(n) OVER (PARTITION BY k) * 0.8)) AS l FROM d WHERE n >= 1)
SELECT k, day, {R('v')} AS v FROM m WHERE n >= l""")
def daily_mean(spark, sf_dir):
    return resample.daily(series(spark, sf_dir), ["k"], "avg", 0.8)


@query(f"""{S} SELECT k, month(ts) AS month, strftime(ts, '%H:%M:%S') AS time, count(v) AS n, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, {R('median(v)')} AS median, {R('quantile_cont(v, 0.25)')} AS q25, {R('quantile_cont(v, 0.75)')} AS q75,
{R('min(v)')} AS min, {R('max(v)')} AS max, {R('avg(v) + stddev_samp(v)')} AS mean_plus_sd, {R('avg(v) - stddev_samp(v)')} AS mean_minus_sd FROM s GROUP BY 1, 2, 3""")
def diel_cycle(spark, sf_dir):
    return resample.diel_cycle(series(spark, sf_dir), ["k"], 1, True)


@query(f"{S} SELECT k, ts, {R('v')} AS v, {R('avg(v) OVER (PARTITION BY k, CAST(ts AS DATE))')} AS aggregate FROM s")
def aggregate_as_high_resolution(spark, sf_dir):
    return resample.broadcast_aggregate(series(spark, sf_dir), ["k"])


@query(f"""{S}, i AS (SELECT *, count(v) OVER (PARTITION BY k ORDER BY ts) AS i FROM s)
SELECT k, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS length, {R('count(*) * 600.0')} AS seconds FROM i WHERE v IS NULL GROUP BY k, i""")
def find_gaps(spark, sf_dir):
    return gaps.find_gaps(series(spark, sf_dir), ["k"])


@query(f"""{S}, i AS (SELECT *, count(v) OVER (PARTITION BY k ORDER BY ts) AS i FROM s) SELECT k, count(DISTINCT i) FILTER (v IS NULL) AS n_gaps FROM i GROUP BY k""")
def count_gaps(spark, sf_dir):
    return gaps.count_gaps(series(spark, sf_dir), ["k"])


@query(f"""{S}, i AS (SELECT *, count(v) OVER (PARTITION BY k ORDER BY ts) AS i FROM s), g AS (SELECT k, min(ts) AS a, count(*) AS length FROM i WHERE v IS NULL GROUP BY k, i),
gm AS (SELECT k, year(a) AS year, month(a) AS month, count(*) AS gaps, count_if(length >= 6) AS long_gaps, max(length) AS longest FROM g GROUP BY 1, 2, 3),
m AS (SELECT k, year(ts) AS year, month(ts) AS month, count(*) AS n, count(*) - count(v) AS missing FROM s GROUP BY 1, 2, 3)
SELECT k, year, month, n, missing, {R('missing / n * 100')} AS missing_percent, coalesce(gaps, 0) AS gaps, coalesce(long_gaps, 0)::BIGINT AS long_gaps, coalesce(longest, 0) AS longest FROM m LEFT JOIN gm USING (k, year, month)""")
def gap_statistics(spark, sf_dir):
    return gaps.gap_statistics(series(spark, sf_dir), ["k"], 6)


@query(f"""{S}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS r FROM s),
p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN r END) OVER (PARTITION BY k ORDER BY ts) AS ra, min(CASE WHEN v IS NOT NULL THEN r END) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rz FROM n)
SELECT p.k, p.ts, {R('p.v')} AS v, {R('coalesce(p.v, CASE WHEN rz - ra - 1 <= 3 THEN a.v + (z.v - a.v) * (p.r - ra) / (rz - ra) END)')} AS filled
FROM p LEFT JOIN n a ON a.k = p.k AND a.r = ra LEFT JOIN n z ON z.k = p.k AND z.r = rz""")
def linear_interpolation(spark, sf_dir):
    return gaps.interpolate(series(spark, sf_dir), ["k"], 3)


QS = ", ".join(f"{R(f'quantile_cont(v, {q})')} AS p{int(q * 100):02d}" for q in stats.LEVELS)


@query(f"""{S}, n AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS r, lag(v) OVER (PARTITION BY k ORDER BY ts) AS b FROM s WHERE v IS NOT NULL),
d AS (SELECT k, avg(abs(v - b)) AS mac, regr_slope(v, r) AS slope, corr(v, b) AS acf FROM n GROUP BY k),
o AS (SELECT k, count_if(abs(v - m) > 3 * sd) AS outliers FROM (SELECT k, v, avg(v) OVER (PARTITION BY k) AS m, stddev_pop(v) OVER (PARTITION BY k) AS sd FROM s) GROUP BY k)
SELECT s.k, min(ts) AS start, max(ts) AS "end", date_diff('second', min(ts), max(ts)) AS period_seconds, count(v) AS n, count(*) - count(v) AS missing, {R('(count(*) - count(v)) / count(*) * 100')} AS missing_percent,
{R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, {R('var_samp(v)')} AS var, {R('stddev_samp(v) / avg(v)')} AS sd_over_mean, {R('stddev_samp(v) / abs(avg(v))')} AS cv, {R('sum(v)')} AS sum, {R('min(v)')} AS min, {R('max(v)')} AS max,
{R('skewness(v)')} AS skew, {R('kurtosis(v)')} AS kurtosis, {QS}, {R('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')} AS iqr, {R('any_value(mac)')} AS mean_abs_change, {R('any_value(slope)')} AS trend_slope, {R('any_value(acf)')} AS acf1,
any_value(outliers)::BIGINT AS outliers, {R('any_value(outliers) * 100 / count(v)')} AS outlier_percent FROM s JOIN d USING (k) JOIN o USING (k) GROUP BY s.k""")
def series_summary(spark, sf_dir):
    return stats.summary(series(spark, sf_dir), ["k"])


W = "OVER (PARTITION BY k ORDER BY ts)"


@query(f"{S} SELECT k, ts, {R('v')} AS v, {R(f'abs(v - lag(v) {W})')} AS to_previous, {R(f'abs(v - lead(v) {W})')} AS to_next, {R(f'abs(v - lag(v) {W}) + abs(v - lead(v) {W})')} AS both FROM s")
def double_difference(spark, sf_dir):
    return stats.double_difference(series(spark, sf_dir), ["k"])


@query(f"""{S}, n AS (SELECT k, v, row_number() {W} - 1 AS r FROM s WHERE v IS NOT NULL)
SELECT k, {R('regr_slope(v, r)')} AS slope, {R('regr_intercept(v, r)')} AS intercept, {R('sqrt(regr_r2(v, r))')} AS r FROM n GROUP BY k""")
def linear_trend(spark, sf_dir):
    return stats.trend(series(spark, sf_dir), ["k"])


@query(f"""{S}, q AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.25) AS a, median(v) AS b, quantile_cont(v, 0.75) AS c FROM s GROUP BY k), d AS (SELECT s.k, v, m, sd, a, b, c FROM s JOIN q USING (k)),
h AS (SELECT k, median(abs(v - b)) AS mad FROM d GROUP BY k)
SELECT k, count_if(abs(v - m) > 2.5 * sd)::BIGINT AS by_zscore, count_if(v < a - 2.5 * (c - a) OR v > c + 2.5 * (c - a))::BIGINT AS by_iqr, count_if(mad > 0 AND abs(v - b) * 0.6745 > 2.5 * mad)::BIGINT AS by_mad FROM d JOIN h USING (k) GROUP BY k""")
def outlier_counts(spark, sf_dir):
    return stats.outlier_counts(series(spark, sf_dir), ["k"], 2.5)


@query(f"{S}, p AS (SELECT k, unnest(range(0, 101)) AS percentile, unnest(quantile_cont(v, [i / 100 for i in range(0, 101)])) AS value FROM s GROUP BY k) SELECT k, percentile::INT AS percentile, {R('value')} AS value FROM p")
def percentiles_0_100(spark, sf_dir):
    return stats.percentiles(series(spark, sf_dir), ["k"])


@query(f"""{S}, d AS (SELECT k, avg(sin(radians(v))) AS a, avg(cos(radians(v))) AS b FROM s GROUP BY k) SELECT k, {R('CASE WHEN degrees(atan2(a, b)) < 0 THEN degrees(atan2(a, b)) + 360 ELSE degrees(atan2(a, b)) END')} AS direction FROM d""")
def circular_mean(spark, sf_dir):
    return stats.circular(series(spark, sf_dir), ["k"], "v")


@query(f"""{S}, e AS (SELECT k, min(v) AS lo, max(v) AS hi FROM s GROUP BY k HAVING min(v) IS NOT NULL), c AS (SELECT s.k, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 12)), 11) ELSE 0 END::INT AS bin, count(*) AS c FROM s JOIN e USING (k) WHERE v IS NOT NULL GROUP BY 1, 2),
g AS (SELECT k, lo, hi, unnest(range(0, 12))::INT AS bin FROM e) SELECT k, bin, {R('lo + bin * ((hi - lo) / 12)')} AS bin_start, coalesce(c, 0) AS count FROM g LEFT JOIN c USING (k, bin)""")
def histogram(spark, sf_dir):
    return binning.histogram(series(spark, sf_dir), ["k"], n=12)


@query(f"{S} SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN {Z} > 2.0 THEN 2 ELSE 0 END AS flag FROM s")
def zscore_flag(spark, sf_dir):
    return outliers.zscore(series(spark, sf_dir), ["k"], 2.0).select("k", "ts", "flag")


C = "OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"


@query(f"""{S}, t AS (SELECT k, ts, CASE WHEN count(v) {C} >= 3 THEN abs(v - avg(v) {C}) / nullif(stddev_samp(v) {C}, 0) END AS z FROM s WHERE v IS NOT NULL)
SELECT s.k, s.ts, CASE WHEN z > 2.2 THEN 2 WHEN z <= 2.2 THEN 0 END AS flag FROM s LEFT JOIN t USING (k, ts)""")
def zscore_rolling_flag(spark, sf_dir):
    return outliers.zscore_rolling(series(spark, sf_dir), ["k"], 24, 2.2).select("k", "ts", "flag")


@query(f"""{S}, a AS (SELECT k, ts, abs(v - lag(v) {W}) AS a, abs(v - lead(v) {W}) AS b FROM s WHERE v IS NOT NULL), c AS (SELECT *, a + b AS c FROM a),
z AS (SELECT k, ts, {' AND '.join(f'coalesce(abs({x} - avg({x}) OVER (PARTITION BY k)) / nullif(stddev_pop({x}) OVER (PARTITION BY k), 0) > 1.5, false)' for x in 'abc')} AS bad FROM c)
SELECT s.k, s.ts, CASE WHEN bad IS NULL THEN NULL WHEN bad THEN 2 ELSE 0 END AS flag FROM s LEFT JOIN z USING (k, ts)""")
def zscore_increments_flag(spark, sf_dir):
    return outliers.zscore_increments(series(spark, sf_dir), ["k"], 1.5).select("k", "ts", "flag")


@query(f"""{S}, m AS (SELECT k, ts, v, abs(v - quantile_cont(v, 0.5) {C}) AS d FROM s WHERE v IS NOT NULL), t AS (SELECT k, ts, d, quantile_cont(d, 0.5) {C} * 1.4826 AS sd FROM m)
SELECT s.k, s.ts, CASE WHEN d IS NULL THEN NULL WHEN sd > 0 AND d > 3.0 * sd THEN 2 ELSE 0 END AS flag FROM s LEFT JOIN t USING (k, ts)""")
def hampel_flag(spark, sf_dir):
    return outliers.hampel(series(spark, sf_dir), ["k"], 24, 3.0).select("k", "ts", "flag")


@query(f"""{S}, x AS (SELECT k, ts, 2 * v - lag(v) {W} - lead(v) {W} AS x FROM s WHERE v IS NOT NULL), m AS (SELECT k, ts, abs(x - quantile_cont(x, 0.5) {C}) AS d FROM x), t AS (SELECT k, ts, d, quantile_cont(d, 0.5) {C} * 1.4826 AS sd FROM m)
SELECT s.k, s.ts, CASE WHEN d IS NULL THEN NULL WHEN sd > 0 AND d > 3.0 * sd THEN 2 ELSE 0 END AS flag FROM s LEFT JOIN t USING (k, ts)""")
def hampel_differences_flag(spark, sf_dir):
    return outliers.hampel(series(spark, sf_dir), ["k"], 24, 3.0, differences=True).select("k", "ts", "flag")


@query(f"""{S}, t AS (SELECT k, ts, CASE WHEN count(v) {C} >= 3 THEN CASE WHEN abs(v - quantile_cont(v, 0.5) {C}) > 2.0 * stddev_samp(v) {C} THEN 2 ELSE 0 END END AS flag FROM s WHERE v IS NOT NULL)
SELECT s.k, s.ts, t.flag FROM s LEFT JOIN t USING (k, ts)""")
def local_sd_flag(spark, sf_dir):
    return outliers.local_sd(series(spark, sf_dir), ["k"], 24, 2.0).select("k", "ts", "flag")


@query(f"""{S}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, ts) AS r, count_if(v < 10) OVER (PARTITION BY k) AS low FROM s)
SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN v < 10 OR r <= low THEN 2 ELSE 0 END AS flag FROM n""")
def trim_low_flag(spark, sf_dir):
    return outliers.trim_low(series(spark, sf_dir), ["k"], 10.0).select("k", "ts", "flag")


@query(f"{S} SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN v NOT BETWEEN 20 AND 80 THEN 2 ELSE 0 END AS limits, CASE WHEN v IS NULL THEN 2 ELSE 0 END AS missing, CASE WHEN v IS NULL THEN NULL WHEN CASE WHEN hour(ts) BETWEEN 7 AND 19 THEN v NOT BETWEEN 10 AND 90 ELSE v NOT BETWEEN 20 AND 60 END THEN 2 ELSE 0 END AS by_day FROM s")
def absolute_limits_flag(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("k", "ts", outliers.absolute_limits("v", 20, 80).alias("limits"), outliers.missing_values().alias("missing"), outliers.absolute_limits_by("v", F.hour("ts").between(7, 19), (10, 90), (20, 60)).alias("by_day"))


@query(f"{S} SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN CAST(ts AS DATE) = '2024-01-03' OR ts BETWEEN '2024-01-10 03:00:00' AND '2024-01-10 09:00:00' THEN 2 ELSE 0 END AS flag FROM s")
def manual_removal_flag(spark, sf_dir):
    return series(spark, sf_dir).select("k", "ts", outliers.manual_removal("v", "ts", ["2024-01-03", ("2024-01-10 03:00:00", "2024-01-10 09:00:00")]).alias("flag"))


ROUNDS = 40  # more than the tables need; further rounds reject nothing


def _rounds() -> str:
    """Round after round what is within two deviations of what the last one left."""
    steps = ["r0 AS (SELECT k, ts, v, v AS x FROM s)"]
    z = "abs(x - avg(x) OVER (PARTITION BY k)) / nullif(stddev_pop(x) OVER (PARTITION BY k), 0)"
    steps += [f"r{i} AS MATERIALIZED (SELECT k, ts, v, CASE WHEN NOT coalesce({z} > 2.0, false) THEN x END AS x FROM r{i - 1})" for i in range(1, ROUNDS + 1)]
    return ", ".join(steps)


@query(f"{S}, {_rounds()} SELECT k, ts, CASE WHEN v IS NULL THEN NULL WHEN x IS NULL THEN 2 ELSE 0 END AS flag FROM r{ROUNDS}")
def repeated_zscore_flag(spark, sf_dir):
    def test(d: DataFrame, c: str) -> DataFrame:
        return outliers.zscore(d, ["k"], 2.0, c, "_t")

    return outliers.repeated(series(spark, sf_dir), test).select("k", "ts", "flag")


@query()
def local_outlier_factor(spark, sf_dir):
    return outliers.lof(series(spark, sf_dir), ["k"], 20).select("k", "ts", "lof")


@query(f"""{S}, f AS (SELECT k, ts, v, CASE WHEN v IS NULL THEN NULL WHEN {Z} > 2.0 THEN 2 ELSE 0 END AS a, CASE WHEN v IS NULL THEN NULL WHEN v > 90 THEN 1 ELSE 0 END AS b FROM s),
q AS (SELECT *, (CASE WHEN a = 1 THEN 1 ELSE 0 END + CASE WHEN b = 1 THEN 1 ELSE 0 END) AS soft, CASE WHEN a = 2 THEN 1 ELSE 0 END AS hard FROM f),
o AS (SELECT k, ts, v, CASE WHEN soft + hard = 0 THEN 0 WHEN hard >= 1 OR soft > 3 THEN 2 ELSE 1 END AS qcf FROM q)
SELECT k, CAST(ts AS DATE) AS day, count(v) AS n, count(v) FILTER (qcf < 2) AS kept, count(v) FILTER (qcf = 0) AS best, {R('avg(v) FILTER (qcf < 2)')} AS mean_kept FROM o GROUP BY 1, 2""")
def daily_quality_summary(spark, sf_dir):
    s = outliers.zscore(series(spark, sf_dir), ["k"], 2.0, name="a").withColumn("b", F.when(F.col("v").isNotNull(), F.when(F.col("v") > 90, 1).otherwise(0)))
    s = s.withColumn("qcf", quality.overall([F.col("a"), F.col("b")]))
    return s.groupBy("k", F.to_date("ts").alias("day")).agg(F.count("v").alias("n"), F.count(F.when(F.col("qcf") < 2, F.col("v"))).alias("kept"), F.count(F.when(F.col("qcf") == 0, F.col("v"))).alias("best"), F.avg(F.when(F.col("qcf") < 2, F.col("v"))).alias("mean_kept"))


@query(f"{S} SELECT k, ts, {R('v')} AS v, {R(f'lag(v, 2) {W}')} AS v_lag_m2, {R(f'lag(v, 1) {W}')} AS v_lag_m1, {R(f'lead(v, 1) {W}')} AS v_lag_p1 FROM s")
def lagged_variants(spark, sf_dir):
    return windows.lagged(series(spark, sf_dir), ["k"], ["v"], -2, 1)


T = "OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query(f"{S} SELECT k, ts, {R('v')} AS v, {R(f'avg(v) {T}')} AS mean_12, {R(f'stddev_pop(v) {T}')} AS sd_12, {R(f'quantile_cont(v, 0.5) {T}')} AS median_12, {R(f'min(v) {T}')} AS min_12, {R(f'max(v) {T}')} AS max_12, {R(f'quantile_cont(v, 0.25) {T}')} AS q25_12, {R(f'quantile_cont(v, 0.75) {T}')} AS q75_12 FROM s")
def rolling_features(spark, sf_dir):
    return windows.rolling(series(spark, sf_dir), ["k"], "v", [12])


@query(f"{S}, d AS (SELECT k, ts, v, v - lag(v) {W} AS d FROM s) SELECT k, ts, {R('v')} AS v, {R(f'd - lag(d) {W}')} AS diff FROM d")
def second_difference(spark, sf_dir):
    return windows.differences(series(spark, sf_dir), ["k"], "v", 2)


@query(f"""{S}, i AS (SELECT *, coalesce(v >= 70, false) AS i FROM s), r AS (SELECT *, count_if(i) {W} AS run FROM i)
SELECT k, ts, {R('v')} AS v, (row_number() OVER (PARTITION BY k, run ORDER BY ts) - CASE WHEN run = 0 THEN 0 ELSE 1 END)::INT AS since FROM r""")
def time_since(spark, sf_dir):
    return windows.time_since(series(spark, sf_dir), ["k"], "v", 70)


CYCLES = ", ".join(f"{R(f'{f}({c} * 2 * pi() / {p})')} AS {c}_{f}" for c, p in (("season", 4), ("month", 12), ("week", 53), ("doy", 365.25), ("hour", 24)) for f in ("sin", "cos"))


@query(f"""WITH t AS (SELECT event_id, year(ts)::INT AS year, CASE WHEN month(ts) IN (3, 4, 5) THEN 1 WHEN month(ts) IN (6, 7, 8) THEN 2 WHEN month(ts) IN (9, 10, 11) THEN 3 ELSE 4 END AS season, month(ts)::INT AS month, week(ts)::INT AS week, dayofyear(ts)::INT AS doy, hour(ts)::INT AS hour FROM events)
SELECT *, {CYCLES}, (year * 100 + month)::INT AS yearmonth, (year * 1000 + doy)::INT AS yeardoy, (year * 100 + week)::INT AS yearweek FROM t""")
def timestamp_features(spark, sf_dir):
    return windows.calendar(events(spark, sf_dir)).drop("k", "ts", "v")


@query(f"{S} SELECT k, ts, {R('v')} AS v, {R(f'sum(v) {W}')} AS cumulative FROM s")
def cumulative(spark, sf_dir):
    return windows.running_sum(series(spark, sf_dir), ["k"], "v")


@query(f"{S} SELECT k, ts, row_number() {W} AS record FROM s")
def record_numbers(spark, sf_dir):
    return windows.record_numbers(series(spark, sf_dir), ["k"]).select("k", "ts", "record")


@query(f"""{S}, n AS (SELECT *, avg(CASE WHEN hour(ts) < 6 THEN v END) OVER (PARTITION BY k, CAST(ts AS DATE)) AS o FROM s), m AS (SELECT k, median(o) AS om FROM n GROUP BY k)
SELECT n.k, ts, {R('v')} AS v, {R('CASE WHEN v IS NULL THEN NULL WHEN hour(ts) < 6 THEN 0 ELSE greatest(v - coalesce(o, om), 0) END')} AS corrected, {R('coalesce(o, om)')} AS "offset" FROM n JOIN m USING (k)""")
def night_zero_offset(spark, sf_dir):
    return corrections.night_offset(series(spark, sf_dir), ["k"], F.hour("ts") < 6)


@query(f"""{S}, b AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY abs(date_diff('microsecond', ts, TIMESTAMP '2024-01-15 10:07:00')), ts) AS r FROM s) SELECT k, ts, CASE WHEN r = 1 THEN 1 ELSE 0 END AS flag FROM b""")
def event_nearest_record(spark, sf_dir):
    return corrections.nearest_record(series(spark, sf_dir), ["k"], "2024-01-15 10:07:00").select("k", "ts", "flag")


@query(f"""{S} SELECT k, ts, {R('CASE WHEN v > 80 THEN 80 ELSE v END')} AS capped, {R("CASE WHEN ts BETWEEN '2024-01-03' AND '2024-01-04' THEN -1 ELSE v END")} AS set_range, {R('CASE WHEN hour(ts) BETWEEN 8 AND 16 THEN v END')} AS kept, {R('CASE WHEN NOT (hour(ts) >= 8 AND hour(ts) < 16) THEN v END')} AS inverted,
CASE WHEN ts BETWEEN '2024-01-05' AND '2024-01-06' THEN 1 ELSE 0 END AS event FROM s""")
def corrections_and_filters(spark, sf_dir):
    v, t = F.col("v"), F.col("ts")
    return series(spark, sf_dir).select("k", "ts", corrections.cap(v, 80.0, "max").alias("capped"), corrections.set_between(v, t, [("2024-01-03", "2024-01-04")], -1.0).alias("set_range"), corrections.keep_where(v, F.hour("ts"), 8, 16).alias("kept"), corrections.keep_where(v, F.hour("ts"), 8, 16, "left", True).alias("inverted"), corrections.event_flag(t, "2024-01-05", "2024-01-06").alias("event"))


@query("""WITH e AS (SELECT event_id, value AS t, value * 0.7 + 10 AS rh FROM events)
SELECT event_id, (round(6.1078 * (1 - rh / 100) * exp(17.08085 * t / (234.175 + t)) * 0.1, 6) + 0.0) AS vpd, (round(2.0 / (t * t), 6) + 0.0) AS ra, (round(t / (1 + 0.32 * 0.01), 6) + 0.0) AS ta, (round((2.501 - 0.00237 * t) * 1e6, 6) + 0.0) AS lambda,
(round(100 / ((2.501 - 0.00237 * t) * 1e6) * 3600, 6) + 0.0) AS et, (round(3.0 * exp(200.0 * (1 / (15.0 + 46.02) - 1 / (t + 46.02))), 6) + 0.0) AS reco, (round(least(greatest(t, 20), 50), 6) + 0.0) AS tolerance FROM e WHERE t > 0.001""")
def meteorology(spark, sf_dir):
    e = events(spark, sf_dir).where("v > 0.001").withColumn("rh", F.col("v") * 0.7 + 10)
    t = F.col("v")
    return e.select("event_id", meteo.vpd_kpa(t, F.col("rh")).alias("vpd"), meteo.aerodynamic_resistance(F.lit(2.0), t).alias("ra"), meteo.air_temperature_from_sonic(t, F.lit(0.01)).alias("ta"), meteo.latent_heat(t).alias("lambda"), meteo.et_from_le(F.lit(100.0), t).alias("et"), meteo.lloyd_taylor(t, F.lit(3.0), F.lit(200.0)).alias("reco"), meteo.swin_tolerance(t).alias("tolerance"))
