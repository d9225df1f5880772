"""Planted signals, closed forms and round trips."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolith.functions import solar
from aeolith.operators import decompose, fill, flux
from aeolith.plans import registry
from aeolith.sources import files
from aeolith.streaming import live

T0 = datetime(2023, 1, 1)
SF = "/root/testdata/sf0.001"


def test_stl_recovers_a_planted_cycle():
    x = np.arange(210)
    y = 10 + 0.05 * x + 3 * np.sin(2 * np.pi * x / 7) + np.random.default_rng(1).normal(0, 0.1, 210)
    t, s, r = decompose.stl_arrays(y, 7, 35)
    assert np.allclose(t + s + r, y)
    assert np.abs(s - 3 * np.sin(2 * np.pi * x / 7))[14:-14].max() < 0.4 and np.abs(t - 10 - 0.05 * x)[14:-14].max() < 0.4


def test_classical_multiplicative(spark):
    rows = [("a", T0 + timedelta(days=i), 100.0 * (1.5 if i % 4 == 0 else 1.0)) for i in range(40)]
    d = decompose.classical(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["k"], 4, "multiplicative").where("trend IS NOT NULL")
    assert d.where(F.abs(F.col("trend") * F.col("seasonal") * F.col("residual") - F.col("v")) > 1e-6).count() == 0 and d.count() == 36
    assert d.agg(F.max(F.abs(F.col("residual") - 1))).first()[0] < 1e-6


def test_harmonics_of_a_cosine(spark):
    rows = [("a", T0 + timedelta(days=i), 5 + 2 * float(np.cos(2 * np.pi * 3 * i / 60 - 0.7))) for i in range(240)]
    got = {r.harmonic: r for r in decompose.harmonics(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["k"], 60, 4).collect()}
    assert abs(got[3].amplitude - 2) < 1e-9 and abs(got[3].phase - 0.7) < 1e-9 and got[1].amplitude < 1e-9


def test_lloyd_taylor_parameters_come_back():
    ta = np.linspace(-5, 25, 200)
    y = 3.2 * np.exp(180 * (1 / 61.02 - 1 / (ta + 46.02)))
    r, e, se = flux.fit_lloyd_taylor(ta, y)
    assert abs(r - 3.2) < 1e-6 and abs(e - 180) < 1e-4 and se < 1e-3


def test_nighttime_partitioning_recovers_respiration(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(48 * 60):
        h = i % 48 / 2
        ta = 10 + 7 * np.sin((h - 9) * np.pi / 12) + 4 * np.sin(i / 48 / 60 * np.pi) + rng.normal(0, 1)
        sw = max(0.0, 600 * np.sin((h - 6) * np.pi / 12))
        reco = 2.5 * np.exp(200 * (1 / 61.02 - 1 / (ta + 46.02)))
        nee = float(reco - 0.02 * sw)
        rows.append(("a", T0 + timedelta(minutes=30 * i), nee, float(ta), float(sw), nee, float(ta), float(reco)))
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, nee double, ta double, sw_in double, nee_f double, ta_f double, truth double")
    p = flux.partition_nighttime(d, ["k"])
    assert p.where("reco IS NULL").count() == 0
    assert p.agg(F.avg(F.abs(F.col("reco") - F.col("truth")) / F.col("truth"))).first()[0] < 0.03
    assert p.where(F.abs(F.col("reco") - F.col("nee_f") - F.col("gpp")) > 1e-9).count() == 0


def test_moving_point_finds_a_planted_threshold():
    rng = np.random.default_rng(3)
    u, ta = rng.uniform(0.02, 0.8, 6000), rng.uniform(0, 20, 6000)
    nee = np.minimum(u / 0.3, 1) * 4 + rng.normal(0, 0.05, 6000)
    assert 0.22 < flux.moving_point(nee, ta, u) < 0.36


def test_mds_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(48 * 24):
        h = i % 48 / 2
        gone = rng.random() < 0.2 or 300 < i < 420
        rows.append(["a", T0 + timedelta(minutes=30 * i), None if gone else float(rng.normal()), float(max(0, 500 * np.sin((h - 6) * np.pi / 12))), float(10 + 8 * np.sin((h - 9) * np.pi / 12) + rng.normal()), float(rng.uniform(0, 12))])
    for i in range(40, 60):
        rows[i][4] = None  # no temperature: the second method
    d = spark.createDataFrame([tuple(r) for r in rows], "k string, ts timestamp_ntz, flux double, swin double, ta double, vpd double")
    got = {r.ts: r for r in fill.mds(d, ["k"]).collect()}
    for k, ts, x, sw, ta, vpd in rows:
        r = got[ts]
        if x is not None:
            assert r.filled == x and r.method is None
            continue
        for method, window, _ in fill.CASCADE:
            near = []
            for _, t, y, s2, t2, v2 in rows:
                if y is None or abs((t - ts).total_seconds()) > window * 43200:
                    continue
                dh = abs((t.hour + t.minute / 60) - (ts.hour + ts.minute / 60))
                sun = abs(sw - s2) <= min(max(sw, 20), 50)
                if method == 1 and ta is not None and t2 is not None and sun and abs(ta - t2) <= 2.5 and abs(vpd - v2) <= 5 or method == 2 and sun or method == 3 and min(dh, 24 - dh) <= 1:
                    near.append(y)
            if len(near) >= 2:
                assert (r.method, r.window, r.n) == (method, window, len(near)) and abs(r.filled - np.mean(near)) < 1e-9
                break


def test_random_uncertainty_needs_enough_records(spark):
    rows = [("a", T0 + timedelta(days=i, hours=12), float(i % 2), 400.0, 10.0, 5.0) for i in range(20)]
    d = flux.random_uncertainty(spark.createDataFrame(rows, "k string, ts timestamp_ntz, flux double, swin double, ta double, vpd double"), ["k"])
    u = [r.uncertainty for r in d.orderBy("ts").collect()]
    assert all(x is not None and 0.45 < x < 0.6 for x in u)
    assert flux.random_uncertainty(d.drop("uncertainty").limit(3), ["k"]).where("uncertainty IS NOT NULL").count() == 0


def test_sun(spark):
    d = spark.range(1).select(solar.potential_radiation(F.lit(172), F.lit(12.5), 47.3, 7.7, 1.0).alias("noon"), solar.potential_radiation(F.lit(172), F.lit(0.5), 47.3, 7.7, 1.0).alias("night"), solar.day_length_hours(F.lit(80), 0.0).alias("equator"), solar.day_length_hours(F.lit(172), 80.0).alias("pole")).first()
    assert 1150 < d.noon < 1250 and d.night == 0 and abs(d.equator - 12) < 0.01 and d.pole == 24


def test_tree_filling_keeps_measurements_and_fills_all(spark):
    rng = np.random.default_rng(4)
    rows = [("a", T0 + timedelta(minutes=30 * i), None if 100 < i < 160 else float(np.sin(i / 8) * 3), float(np.sin(i / 8)), float(rng.normal())) for i in range(600)]
    rows[120] = rows[120][:3] + (None, 0.0)
    d, scores = fill.by_trees(spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double, a double, b double"), ["k"], "y", ["a", "b"])
    got = {r.ts: r for r in d.collect()}
    assert len(got) == 600 and all(got[r[1]].filled == r[2] for r in rows if r[2] is not None) and all(r.filled is not None for r in got.values())
    assert scores["r2"] > 0.9 and {r.fill_flag for r in got.values()} == {0, 1, 2}


def test_tree_filling_learns_each_series_apart(spark):
    rng = np.random.default_rng(5)
    level = {"a": 0.0, "b": 1000.0}
    rows = [(k, T0 + timedelta(minutes=30 * i), None if 100 < i < 160 else level[k] + float(np.sin(i / 8)), float(np.sin(i / 8)), float(rng.normal())) for k in level for i in range(400)]
    rows += [("c", T0, None, 0.0, 0.0)]
    d, _ = fill.by_trees(spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double, a double, b double"), ["k"], "y", ["a", "b"])
    got = d.where("y IS NULL").collect()
    assert len(got) == 119 and all(abs(r.filled - level[r.k]) < 2 for r in got if r.k != "c")
    assert [(r.filled, r.fill_flag) for r in got if r.k == "c"] == [(None, None)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["mds_gap_filling", "tree_gap_filling", "nighttime_partitioning", "flux_chain"])
def test_queries_take_every_series(spark, name):
    want = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    assert {r.k for r in registry.queries()[name](spark, SF).select("k").collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ustar_detection_draws_a_hundred_times(spark, monkeypatch):
    monkeypatch.setattr(flux, "ustar_percentiles", lambda found, keys: found)
    got = registry.queries()["ustar_detection"](spark, SF).groupBy("k").agg(F.countDistinct("draw").alias("n")).collect()
    assert got and {r.n for r in got} == {100}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIMESTAMP_END,FC,TA,TA\n202301010030,1.5,-9999,3\n202301010100,NaN,2,x\nbad,1,2,3\n")
    d = files.read_text(spark, f"file://{tmp_path}/a.csv", "csv_30min_end").orderBy("ts")
    assert d.columns == ["ts", "FC", "TA", "TA.1"]
    assert [tuple(r)[1:] for r in d.collect()] == [(1.0, 2.0, 3.0), (1.5, None, 3.0), (None, 2.0, None)]
    (tmp_path / "b.dat").write_text('"TOA5","x"\nTIMESTAMP,T\nTS,C\n,Avg\n2023-01-01 00:01:00,1\n')
    assert [tuple(r) for r in files.read_text(spark, f"file://{tmp_path}/b.dat", "logger_1min").collect()] == [(datetime(2023, 1, 1, 0, 1), 1.0)]


def test_combine_first_and_projects(spark, tmp_path):
    a, b = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None)], "k int, x double, y double"), spark.createDataFrame([(1, 9.0), (3, 7.0)], "k int, x double")
    assert [tuple(r) for r in files.combine_first([a, b], ["k"]).orderBy("k").collect()] == [(1, 9.0, 2.0), (2, 5.0, None), (3, 7.0, None)]
    files.write_project(a, f"file://{tmp_path}/p", {"tags": ["x"]})
    d, meta = files.read_project(spark, f"file://{tmp_path}/p")
    assert d.count() == 2 and meta == {"tags": ["x"]}


def test_yearly_export(spark, tmp_path):
    rows = [(datetime(2022, 12, 31, 23, 45), 1.0), (datetime(2023, 1, 1, 0, 15), None)]
    files.write_yearly_csv(spark.createDataFrame(rows, "ts timestamp_ntz, x double"), f"file://{tmp_path}/out")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/out").orderBy("year").collect()
    assert [(r.TIMESTAMP_START, r.TIMESTAMP_END, float(r.x), r.year) for r in got] == [("202212312330", "202301010000", 1.0, 2022), ("202301010000", "202301010030", -9999.0, 2023)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", datetime(2023, 1, 1, 0, i), float(i)) for i in range(0, 50, 5)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    d.write.parquet(f"{tmp_path}/in")
    q = live.resample(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), ["k"], 600).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.ts: r.v for r in spark.sql("SELECT * FROM live").collect()}
    assert got and all(v == (m := ts.minute or 60) - 10 + 2.5 for ts, v in got.items())


def test_chain_order_is_enforced(spark):
    d = spark.createDataFrame([("a", T0, 1.0)], "k string, ts timestamp_ntz, flux double")
    with pytest.raises(ValueError):
        flux.Chain(d, flux.Site(47.0, 8.0, 1.0), ["k"], "flux").level31("storage")
