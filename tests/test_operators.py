"""Operators on small hand-made series."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from aeolith.functions import codes
from aeolith.operators import binning, corrections, gaps, outliers, quality, stats, timeaxis, windows

T0 = datetime(2024, 1, 1)


def frame(spark, values, step=600):
    rows = [("a", T0 + timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def column(df, name, by="ts"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_regularize_drops_rows_off_the_grid(spark):
    rows = [("a", T0, 1.0), ("a", T0 + timedelta(minutes=7), 9.0), ("a", T0 + timedelta(minutes=30), 2.0)]
    d = timeaxis.regularize(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["k"], 600)
    assert column(d, "v") == [1.0, None, None, 2.0]


def test_empty_series(spark):
    d = frame(spark, [])
    assert timeaxis.regularize(d, ["k"], 600).count() == 0
    assert gaps.find_gaps(d, ["k"]).count() == 0
    assert outliers.zscore(d, ["k"]).count() == 0


def test_interpolation_leaves_long_gaps_and_ends(spark):
    d = gaps.interpolate(frame(spark, [None, 1, None, None, 4, None, None, None, None, 9, None]), ["k"], 3)
    assert column(d, "filled") == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, None, 9.0, None]


def test_zscore_flags_a_spike_and_constant_series_pass(spark):
    assert column(outliers.zscore(frame(spark, [1] * 30 + [100] + [None]), ["k"], 4), "flag") == [0] * 30 + [2, None]
    assert column(outliers.zscore(frame(spark, [5] * 4), ["k"], 4), "flag") == [0] * 4


def test_repeated_removes_masked_spikes(spark):
    d = frame(spark, [0, 1] * 20 + [50, 1000])
    once = column(outliers.zscore(d, ["k"], 4), "flag")
    many = column(outliers.repeated(d, lambda x, c: outliers.zscore(x, ["k"], 4, c, "_t")), "flag")
    assert once[-2:] == [0, 2] and many[-2:] == [2, 2]


def test_repeated_goes_on_until_nothing_is_rejected(spark):
    def largest(d, c):
        top = F.max(c).over(Window.partitionBy("k"))
        return d.withColumn("_t", F.when((F.col(c) == top) & (top > 3), 2).otherwise(0))

    assert column(outliers.repeated(frame(spark, list(range(60))), largest), "flag") == [0] * 4 + [2] * 56


def test_hampel_with_no_deviation_rejects_nothing(spark):
    assert set(column(outliers.hampel(frame(spark, [1] * 20 + [50] + [1] * 20), ["k"], 9, 3), "flag")) == {0}


def test_lof_against_brute_force(spark):
    v = np.random.default_rng(3).normal(size=60).tolist() + [9.0]
    k = 5
    got = {round(r.v, 9): r.lof for r in outliers.lof(frame(spark, v), ["k"], k).collect()}
    x = np.array(v)
    d = np.abs(x[:, None] - x[None])
    order = np.argsort(d, 1)[:, 1 : k + 1]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[order], np.take_along_axis(d, order, 1)).mean(1) + 1e-10)
    want = lrd[order].mean(1) / lrd
    assert all(abs(got[round(a, 9)] - b) < 1e-6 for a, b in zip(v, want, strict=True))


def test_time_since(spark):
    assert column(windows.time_since(frame(spark, [0, 5, None, 0, 6, 0]), ["k"], "v", 5), "since") == [1, 0, 1, 2, 0, 1]


def test_bias_corrected_moments(spark):
    r = frame(spark, [1, 2, 3, 4, 10]).agg(stats.skewness("v").alias("s"), stats.kurtosis("v").alias("k")).first()
    assert abs(r.s - pd.Series([1, 2, 3, 4, 10]).skew()) < 1e-9 and abs(r.k - pd.Series([1, 2, 3, 4, 10]).kurt()) < 1e-9


def test_digits_and_bits(spark):
    d = spark.createDataFrame([(81000192,), (None,), (-5,)], "c long")
    assert [r[0] for r in d.select(codes.digit(F.col("c"), 1)).collect()] == [1, None, None]
    assert spark.range(1).select(codes.bits(F.lit(0b10110100), 0, 4)).first()[0] == 11.0


def test_overall_flag(spark):
    cases = [((0, 0, 0, 0), 0), ((1, 1, 1, 0), 1), ((1, 1, 1, 1), 2), ((2, 0, 0, 0), 2), ((2, 2, 0, 0), 2), ((None, 0, 0, 0), 0)]
    d = spark.createDataFrame([c for c, _ in cases], "a int, b int, c int, d int")
    assert [r[0] for r in d.select(quality.overall([F.col(x) for x in "abcd"])).collect()] == [q for _, q in cases]


def test_combine_division_by_zero_and_nulls(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (6.0, 3.0)], "a double, b double")
    q = [r[0] for r in d.select(corrections.combine(F.col("a"), F.col("b"), "divide")).collect()]
    assert q == [float("inf"), float("-inf"), None, None, 2.0]


def test_keep_where_inverted_keeps_null_conditions(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, 50.0)], "v double, c double")
    assert [r[0] for r in d.select(corrections.keep_where(F.col("v"), F.col("c"), 0, 10, invert=True)).collect()] == [1.0, None, 3.0]


def test_histogram_counts_every_value_and_keeps_empty_bins(spark):
    h = binning.histogram(frame(spark, [0, 0, 1, 10]), ["k"], n=5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 0, 0, 0, 1]


def test_replicate_offset_is_the_median_difference(spark):
    d = spark.createDataFrame([("a", 1.0, 3.1), ("a", 2.0, 4.1), ("a", 3.0, 50.0)], "k string, m double, r double")
    assert abs(corrections.offset_from_replicate(d, ["k"], "m", "r").first().offset - 2.1) < 1e-9


def test_humidity_offset(spark):
    d = frame(spark, [99, 102, 104, None], 3600)
    assert column(corrections.humidity_offset(d, ["k"]), "corrected") == [96.0, 99.0, 100.0, None]
