"""Planted curves, closed forms and round trips of features, fits, partitioning, screening, self-heating, long records, drivers, names and metadata."""

import os
import pickle
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolith.functions import names
from aeolith.operators import corrections, decompose, drivers, engineer, fits, flux, gaps, longterm, outliers, partition, screening, selfheating, shapes, stats
from aeolith.sources import formats, influx
from aeolith.sources.files import TextFormat
from aeolith.sources.metadata import Store, origin_note

T0 = datetime(2023, 5, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def net(spark):
    """40 days of half hours whose exchange follows known curves, with noise."""
    rng, rows = np.random.default_rng(3), []
    for i in range(48 * 40):
        h = i % 48 / 2
        ta = 12 + 7 * np.sin((h - 9) * np.pi / 12) + 5 * np.sin(i / 48 / 12) + rng.normal(0, 0.5)
        sw = max(0.0, 700 * np.sin((h - 5) * np.pi / 14)) if 5 <= h <= 19 else 0.0
        vpd = max(0.0, 6 + 7 * np.sin((h - 9) * np.pi / 12))
        reco = 3.0 * np.exp(180 * (1 / 61.02 - 1 / (ta + 46.02)))
        top = 28 * np.exp(-0.03 * max(vpd - 10, 0))
        gpp = 0.05 * top * sw / (0.05 * sw + top) if sw else 0.0
        nee = reco - gpp + rng.normal(0, 0.2)
        rows.append(("a", T0 + timedelta(minutes=30 * i), None if rng.random() < 0.2 else float(nee), float(ta), float(sw), float(vpd), float(nee), float(reco), float(gpp)))
    d = frame(spark, rows, "k string, ts timestamp_ntz, nee double, ta double, sw_in double, vpd double, nee_f double, reco_true double, gpp_true double")
    return d.withColumns({"ta_f": F.col("ta"), "sw_in_f": F.col("sw_in")}).cache()


@pytest.mark.parametrize("smooth", [False, True])
def test_daytime_partitioning_recovers_both_fluxes(net, smooth):
    got = partition.daytime(net, ["k"], vpd_in_kpa=False, smooth=smooth).toPandas()
    assert got.reco_dt.notna().all() and got.gpp_dt.notna().all()
    assert abs(got.reco_dt.mean() / got.reco_true.mean() - 1) < 0.1 and abs(got.gpp_dt.mean() / got.gpp_true.mean() - 1) < 0.06
    assert np.sqrt(((got.gpp_dt - got.gpp_true) ** 2).mean()) < 1.0
    assert got.lrc_alpha.dropna().between(0, 0.22).all() and len(got.lrc_alpha.dropna()) > 10


def test_nighttime_of_a_whole_record(net):
    got = partition.nighttime_whole_record(net, ["k"], 47.0, 8.0, 1.0).toPandas()
    assert got.e0.nunique() == 1 and abs(got.e0.iloc[0] - 180) < 40
    assert abs(got.reco.mean() / got.reco_true.mean() - 1) < 0.08 and np.allclose(got.gpp, got.reco - got.nee_f)


def test_least_squares_and_light_response():
    x = np.linspace(0, 10, 80)
    p, se, rmse = partition.least_squares(lambda q: q[0] * np.exp(-q[1] * x), 4 * np.exp(-0.7 * x), 1.0, [1.0, 0.1])
    assert np.allclose(p, [4, 0.7], atol=1e-5) and rmse < 1e-6
    rg, vpd, ta = np.linspace(5, 900, 120), np.linspace(2, 20, 120), np.linspace(8, 25, 120)
    nee = partition.respiration(ta, 3.0, 200.0) - partition.uptake(rg, vpd, 0.06, 30.0, 0.04)
    v = partition.light_response(nee, rg, vpd, ta, 1.0, 200.0, (0.01, 25.0, 0.0, 2.5), None)
    assert abs(v["alpha"] - 0.06) < 0.01 and abs(v["beta"] - 30) < 3 and abs(v["rref"] - 3) < 0.2
    dark = partition.light_response(partition.respiration(ta, 3.0, 200.0) + 0.02 * rg, rg, vpd, ta, 1.0, 200.0, (0.01, 25.0, 0.0, 2.5), None)
    assert dark is None or dark["alpha"] >= 0


def test_ustar_quantiles_and_years(spark):
    rng, rows = np.random.default_rng(5), []
    for y in (2020, 2021, 2022, 2023):
        for i in range(1500):
            u = float(rng.uniform(0.02, 0.8))
            rows.append(("a", datetime(y, 1, 1) + timedelta(hours=5.5 * i), float(4 * min(1, u / 0.3) + rng.normal(0, 0.15)), float(rng.uniform(0, 20)), u))
    d = frame(spark, rows, "k string, ts timestamp_ntz, nee double, ta double, ustar double")
    got = [r.threshold for r in flux.detect_ustar_quantiles(d, ["k"]).collect()]
    assert len(got) == 4 and all(0.2 < t < 0.4 for t in got)
    by = {r.year: r for r in flux.windowed_ustar(d, ["k"], 5).collect()}
    assert sorted(by) == [2020, 2021, 2022, 2023] and all(r.p16 <= r.p50 <= r.p84 for r in by.values())
    t = frame(spark, [("a", y, 0.3) for y in (2020, 2021, 2022)], "k string, year int, threshold double")
    with pytest.raises(ValueError, match="threshold"):
        flux.ustar_flag_by_record(d, ["k"], "nee", t)
    flagged = flux.ustar_flag_by_record(d.where("year(ts) < 2023"), ["k"], "nee", t)
    assert flagged.where("(ustar >= 0.3) <> (flag = 0)").count() == 0


def test_chain_with_scenarios_and_reset(net):
    d = net.withColumns({"flux": F.col("nee"), "swin": F.col("sw_in"), "ustar": F.pmod(F.hour("ts") * 7 + F.minute("ts"), F.lit(10)) / 20, "storage": F.lit(0.1)}).select("k", "ts", "flux", "swin", "ta", "vpd", "ustar", "storage")
    site = flux.Site(47.0, 8.0, 1.0)
    c = flux.Chain(d, site, ["k"], "flux")
    with pytest.raises(ValueError, match="L0"):
        c.level2([F.lit(0)])
    c = c.level0().level2([F.lit(0)]).level31("storage").level32(96).level33({"a": 0.1, "b": 0.3})
    assert c.scenarios == ("a", "b") and {"flux_l33_a", "flux_l33_b"} <= set(c.df.columns)
    n = c.df.agg(F.count("flux_l33_a").alias("a"), F.count("flux_l33_b").alias("b")).first()
    assert n.a > n.b > 0
    c = c.level41("mds").level42("nighttime").level42("daytime")
    assert {"reco_a", "gpp_b", "reco_daytime_a"} <= set(c.df.columns) and c.filled_pairs()["flux_l41_b"] == "flux_l33_b"
    assert c.fill_qualities().agg(F.sum("n")).first()[0] == 2 * 48 * 40
    total = c.cumulative().where("column = 'flux_l41_a'").orderBy("ts").tail(1)[0].total
    assert abs(total - c.df.agg(F.sum("flux_l41_a")).first()[0]) < 1e-6
    back = c.level33(0.2)
    assert "flux_l33_a" not in back.df.columns and "reco_a" not in back.df.columns and back.scenarios == ("",) and "flux_l32" in back.df.columns
    assert c.gap_statistics().count() > 0
    with pytest.raises(ValueError, match="only left"):
        c.with_driver(d.limit(5).select("k", "ts", F.lit(1).alias("x")), "x")
    assert "x" in c.with_driver(d.select("k", "ts", F.lit(1).alias("x")), "x").df.columns


def test_engineered_features(spark):
    x = [1.0, 4.0, None, 9.0, 16.0, 25.0]
    d = frame(spark, [("a", T0 + timedelta(minutes=i), v, 0.0) for i, v in enumerate(x)], "k string, ts timestamp_ntz, x double, y double")
    e = engineer.Engineer("y", lags=(-2, 2), lag_step=2, rolling=(3,), statistics=("q25", "max"), differences=(1, 2), exponential=(3,), powers=3, clock=True, record_number=True)
    got = e.transform(d, ["k"]).orderBy("ts").toPandas()
    assert got[".x-2"].iloc[[3, 5]].tolist() == [4.0, 9.0] and np.isnan(got[".x-2"].iloc[4]) and got[".x+2"].iloc[1] == 9.0 and got[".x_DIFF2"].iloc[5] == 25 - 32 + 9
    assert got[".x_POL3"].iloc[1] == 64 and got[".x_ROLLMAX3"].iloc[3] == 9 and got[".RECORDNUMBER"].tolist() == [1, 2, 3, 4, 5, 6]
    ema, m, w = [], None, 1.0  # by hand: a missing value halves the weight of what is known
    for v in x:
        if v is None:
            w *= 0.5
        else:
            m = v if m is None else (w * 0.5 * m + 0.5 * v) / (w * 0.5 + 0.5)
            w = 1.0
        ema.append(m)
    assert np.allclose(got[".x_EMA3"], ema)
    again = e.transform(e.transform(d, ["k"]).select("k", "ts", "x", "y", "`.x_POL2`"), ["k"])
    assert not [c for c in again.columns if c.startswith("..")]


def test_curves(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 5, 400)
    y = 2 * x**2 - 3 * x + 1 + rng.normal(0, 0.5, 400)
    d = frame(spark, [(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    c = fits.fit_curve(d, "x", "y")
    want, cov = np.polyfit(x, y, 2, cov=True)
    assert np.allclose(c.coefficients, want) and np.allclose(c.covariance, cov, rtol=1e-6) and c.r2 > 0.98
    p = c.predictions(50)
    assert (p.lower_band < p.lower_ci).all() and (p.upper_ci < p.upper_band).all()
    inside = np.mean((y > np.interp(x, p.fit_x, p.lower_band)) & (y < np.interp(x, p.fit_x, p.upper_band)))
    assert 0.92 < inside < 0.98
    assert np.allclose(fits.fit_curve(d, "x", "y", "cubic").coefficients, np.polyfit(x, y, 3))
    assert fits.fit_curve(d, "x", "y", "quadratic", bins=8).n == 8
    with pytest.raises(ValueError, match="too few"):
        fits.fit_curve(d.limit(2), "x", "y")


def test_precedence_entropy_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.r_[0, 0, x[:-2]] * 0.9 + rng.normal(0, 0.3, 300)
    d = frame(spark, [("a", T0 + timedelta(days=i), float(x[i]), float(y[i])) for i in range(300)], "k string, ts timestamp_ntz, x double, y double")
    got = {r.lag: r for r in fits.granger(d, ["k"], "x", "y", 3).collect()}
    assert got[2].p < 1e-6 and got[1].p > 1e-3
    # the F of two lags, by plain regressions
    rows = np.arange(2, 300)
    own = np.stack([np.ones(298), y[rows - 1], y[rows - 2]], 1)
    both = np.c_[own, x[rows - 1], x[rows - 2]]
    rss = [((y[rows] - a @ np.linalg.lstsq(a, y[rows], rcond=None)[0]) ** 2).sum() for a in (own, both)]
    assert abs(got[2].f - (rss[0] - rss[1]) / 2 / (rss[1] / (298 - 5))) < 1e-6 * got[2].f
    assert {r.p for r in fits.granger(d.withColumn("z", F.lit(1.0)), ["k"], "z", "y", 1).collect()} is not None
    wave = frame(spark, [("a", T0 + timedelta(days=i), float(np.sin(i / 3))) for i in range(200)] + [("b", T0 + timedelta(days=i), float(rng.normal())) for i in range(200)], "k string, ts timestamp_ntz, v double")
    e = {r.k: r.entropy for r in fits.approximate_entropy(wave, ["k"]).collect()}
    assert e["a"] < 0.5 * e["b"]
    s = fits.spectrogram(wave.where("k = 'a'"), ["k"], 64)
    top = s.groupBy("segment").agg(F.max_by("frequency", "power").alias("f")).collect()
    assert len(top) == 3 and all(abs(r.f - 1 / (6 * np.pi)) < 1 / 64 for r in top)


def test_drivers(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        a, b, c = rng.uniform(0, 1, 3)
        rows.append(("a", T0 + timedelta(hours=i), float(5 * a + 2 * b + 3 * a * b), float(a), float(b), float(c)))
    d = frame(spark, rows, "k string, ts timestamp_ntz, y double, a double, b double, c double")
    x = drivers.Drivers(d, "y", ["a", "b", "c"]).fit()
    assert x.result.scores["r2"] > 0.85
    t = {r.driver: r for r in x.shap().result.tables["shap"].collect()}
    assert t["a"].rank == 1 and t["b"].rank == 2 and t["a"].importance > 1.5 * t["b"].importance > 4 * t["c"].importance and t["a"].relevant
    pairs = {(r["first"], r["second"]): r.interaction for r in x.interactions(2).result.tables["interactions"].collect()}
    assert pairs["a", "b"] > pairs["a", "c"]
    e = x.effects("a", 8).orderBy("edge").toPandas()
    assert e.effect.is_monotonic_increasing and abs((e.effect.iloc[-1] - e.effect.iloc[0]) - 6.5) < 2.5
    s = x.effects_2d("a", "b", 4).toPandas()
    assert s.effect.iloc[0] > 0 and abs(s.effect.mean()) < 1e-9
    assert x.stratified(F.when(F.hour("ts") < 12, "am").otherwise("pm"), 30).result.tables["stratified"].select("stratified").distinct().count() == 2
    assert x.rolling(25, 50).result.tables["window"].where("rank = 1 AND driver = 'a'").count() == 2
    assert x.scales(["k"]).result.tables["scale"].select("scale").distinct().count() == 2
    lagged = drivers.Drivers(d.withColumn("y", F.lag("a", 2).over(__import__("pyspark").sql.Window.partitionBy("k").orderBy("ts"))), "y", ["a", "b"]).lagged(["k"], [0, 1, 2]).result.tables["lagged"]
    assert lagged.orderBy("rank").first().asDict().items() >= {"driver": "a", "lag": 2}.items()
    assert {r.driver for r in x.granger(["k"], 2).result.tables["granger"].collect()} == {"a", "b", "c"}


def test_years_and_search(spark):
    assert longterm.pools([2010, 2011, 2012, 2013]) == {2010: [2010, 2011, 2012], 2011: [2010, 2011, 2012], 2012: [2011, 2012, 2013], 2013: [2011, 2012, 2013]}
    assert longterm.pools([2010]) == {2010: [2010]} and longterm.pools([2010, 2012]) == {2010: [2010, 2012], 2012: [2010, 2012]}
    rng, rows = np.random.default_rng(6), []
    for y in (2020, 2021, 2022):
        for i in range(300):
            a, b = rng.uniform(0, 1, 2)
            rows.append((datetime(y, 1, 1) + timedelta(days=i), None if i % 10 == 3 else float(4 * a + y - 2020), float(a) if i % 50 != 3 else None, float(b)))
    d = frame(spark, rows, "ts timestamp_ntz, y double, a double, b double")
    f = longterm.fill_yearly(d, "y", ["a", "b"], reduce=True, importances=True)
    got = f.df.toPandas()
    assert len(got) == 900 and got.filled.notna().all() and f.features == ["a"] and set(f.scores) == {2020, 2021, 2022}
    assert set(got.fill_flag) == {0, 1, 2} and (got[got.fill_flag == 2].a.isna()).all() and (got[got.fill_flag == 0].filled == got[got.fill_flag == 0].y).all()
    assert f.importances.select("year").distinct().count() == 3
    t = longterm.search(d.dropna(), "y", ["a", "b"], {"maxDepth": [1, 6]}, folds=3).orderBy("rank").collect()
    assert t[0].maxDepth == "6" and t[0].mse < t[1].mse


def test_radiation_is_filled(spark):
    rows = []
    for i in range(48 * 12):
        h = i % 48 / 2
        pot = max(0.0, 900 * np.sin((h - 6) * np.pi / 12))
        gone = i % 48 in (20, 21) and i // 48 == 3 or i // 48 == 7 and 14 < i % 48 < 40 or i // 48 == 5 and i % 48 < 8
        rows.append(("a", T0 + timedelta(minutes=30 * i), float(pot), None if gone else float(0.7 * pot)))
    got = longterm.fill_radiation(frame(spark, rows, "k string, ts timestamp_ntz, potential double, v double"), ["k"]).toPandas()
    assert got.filled.notna().all() and set(got.fill_flag) == {0, 1, 3, 4}
    assert np.allclose(got[got.fill_flag == 4].filled, 0.7 * got[got.fill_flag == 4].potential) and (got[got.fill_flag == 3].filled == 0).all()
    model = got[got.fill_flag == 1]
    assert abs(model.filled.sum() / (0.7 * model.potential.sum()) - 1) < 0.1


def test_screening_in_steps(spark):
    v = [5.0] * 40 + [50.0, 5.0, -30.0] + [5.0 + i % 3 for i in range(40)] + [None]
    d = frame(spark, [("a", T0 + timedelta(minutes=30 * i), x) for i, x in enumerate(v)], "k string, ts timestamp_ntz, v double")
    limits = lambda x, c, name: x.withColumn(name, outliers.absolute_limits(c, -100, 40))
    z = lambda x, c, name: outliers.zscore(x, ["k"], 3.0, c, name)
    s = screening.Screening.of(d, ["k"], "v")
    with pytest.raises(ValueError, match="no test"):
        s.keep()
    s = s.try_("LIMITS", limits).keep().try_("ZSCORE", z, repeat=True).keep().try_("ZSCORE", z).keep()
    assert s.flags == ("FLAG_v_OUTLIER_LIMITS_TEST", "FLAG_v_OUTLIER_ZSCORE_TEST", "FLAG_v_OUTLIER_ZSCORE_2_TEST")
    out = s.overall().toPandas()
    assert sorted(out[out.qcf == 2].v) == [-30.0, 50.0] and out.filtered.notna().sum() == len(v) - 3
    assert s.report().where("test = 'FLAG_v_OUTLIER_LIMITS_TEST'").first().newly_rejected == 1
    assert screening.suggest_neighbours(5) == 4 and screening.suggest_neighbours(500) == 20
    lof = screening.lof_flag(d, ["k"], 10).toPandas()
    assert set(lof[lof.flag == 2].v) >= {50.0, -30.0} and lof.flag.isna().sum() == 1
    assert {r.x for r in frame(spark, [(0,), (2,), (7,), (None,)], "c int").select(screening.steady_state_flag(F.col("c")).alias("x")).collect()} == {0, 2, None}


def test_self_heating_factor_and_use(spark):
    rng, rows = np.random.default_rng(7), []
    for i in range(3000):
        u, c = float(rng.uniform(0.05, 0.9)), float(rng.uniform(0.2, 1.0))
        f = float(rng.normal(0, 1))
        rows.append(("a", T0 + timedelta(minutes=30 * i), i // 24 % 2, u if i % 37 else None, c if i % 41 else None, f, f + c * (2.0 if i // 24 % 2 else 5.0)))
    d = frame(spark, rows, "k string, ts timestamp_ntz, daytime int, class_var double, correction double, flux double, reference double")
    t = selfheating.scaling_factors(d, ["k"], 4, 20)
    got = {(r.daytime, r["class"]): r for r in t.collect()}
    assert len(got) == 8 and all(abs(r.factor - (2 if day else 5)) < 1e-6 and r.q25 <= r.factor <= r.q75 for (day, _), r in got.items())
    out = selfheating.apply_scaling(d, t, ["k"]).toPandas()
    assert out.factor.notna().all() and np.allclose(out[out.corrected_flag == 1].corrected, out[out.corrected_flag == 1].reference)
    assert (out[out.corrected_flag == 0].corrected == out[out.corrected_flag == 0].flux).all() and (out.corrected_flag == 0).sum() == sum(i % 41 == 0 for i in range(3000))
    c, y = rng.uniform(0.1, 1, 200), rng.normal(size=200)
    ref = y + 3 * c + rng.normal(0, 0.5, 200)
    f, cost = selfheating.best_factor(c, y, ref)
    assert all(cost <= np.abs(np.cumsum(y + g * c) - np.cumsum(ref)).sum() + 1e-9 for g in np.linspace(0, 10, 2001))
    spiky = frame(spark, [("a", T0 + timedelta(minutes=i), 100.0 if i == 50 else float(i % 7)) for i in range(200)], "k string, ts timestamp_ntz, x double")
    assert selfheating.without_outliers(spiky, ["k"], "x", 60).where("x IS NULL").count() == 1


def test_lag_ranges_and_densities(spark):
    n = {0.0: 1, 0.5: 2, 1.0: 30, 1.5: 100, 2.0: 40, 2.5: 3, 3.0: 2, 3.5: 1}
    d = frame(spark, [("a", x) for x, k in n.items() for _ in range(k)], "k string, lag double")
    r = shapes.lag_ranges(d, ["k"], "lag").first()
    # the last value closes the bin before it; slopes of the shares are below 0.15 at 0.5 (0.145) and, past the peak, from 3.0 on (2.5 has 0.185)
    assert (r.peak, r.peak_min, r.peak_max) == (1.5, 0.5, 3.0)
    assert abs(r.window_min - (r.peak_min - 0.05)) < 1e-9 and abs(r.window_max - (r.peak_max + 0.05)) < 1e-9
    x = np.random.default_rng(8).normal(10, 2, 4000)
    g = shapes.density(frame(spark, [("a", float(v)) for v in x], "k string, v double"), ["k"], 200).orderBy("x").toPandas()
    h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((g.x.to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(g.density - want).max() < 2e-3 * want.max()


def test_corrections_gaps_days_parts(spark):
    d = frame(spark, [("a", T0 + timedelta(minutes=30 * i), float(i)) for i in range(10)], "k string, ts timestamp_ntz, v double")
    with pytest.raises(ValueError, match="no correction"):
        corrections.apply_all(d, ["k"], [{"key": "what"}])
    with pytest.raises(ValueError, match="nights"):
        corrections.apply_all(d, ["k"], [{"key": "radiation_zero_offset"}])
    assert corrections.apply_all(d, ["k"], [{"key": "setto_max", "threshold": 4.0}, {"key": "radiation_zero_offset"}], F.col("v") < 2).agg(F.max("v")).first()[0] == 3.5
    holes = d.withColumn("v", F.when(~F.col("v").isin(2.0, 3.0, 8.0), F.col("v")))
    g = gaps.gap_at(gaps.find_gaps(holes, ["k"]), ["k"], str(T0 + timedelta(minutes=30 * 6 + 1))).first()
    assert g.gap_start == T0 + timedelta(minutes=240)
    parts = decompose.classical(frame(spark, [("a", T0 + timedelta(days=i), 10.0 + i % 4) for i in range(40)], "k string, ts timestamp_ntz, v double"), ["k"], 4)
    assert decompose.reconstruct(parts).where("abs(reconstructed - v) > 1e-9").count() == 0
    days = frame(spark, [("a", i, 10, r) for i, r in enumerate([0.9, 0.91, 0.92, 0.9, -0.5, None])], "k string, day int, n int, r double")
    assert [r.day for r in stats.days_by_correlation(days, False).orderBy("rank").collect()][0] == 4
    assert [r.day for r in stats.unusual_days(days, ["k"], 1.5).collect()] == [4] and [r.day for r in stats.unusual_days(days, ["k"], 3.0, "iqr").collect()] == [4]


def test_names():
    assert names.classify("NEE_CUT_REF_f") == names.Kind("NEE", "carbon") and names.classify("FC") == names.Kind("FC", "carbon") and names.classify("FCH4_x").kind == "FCH4"
    assert names.classify("TARGET") is None and names.classify("TA").category == "meteo" and names.classify("QC_NEE") is None and names.classify(3) is None
    assert names.pick(["SW_IN_POT", "SW_IN_T1", "TA"], "SW_IN", avoid="POT") == "SW_IN_T1" and names.pick(["TA_1", "TA_F"], "TA", prefer="_F") == "TA_F" and names.pick([], "TA") == ""
    assert names.measurement_of("SWC_1") == "SWC" and names.measurement_of("SW_IN") == "SW" and names.measurement_label("TA") == "TA - air temperature" and names.measurement_label("ZZ") == "ZZ"
    assert names.corrections_for("SW")[0] == "radiation_zero_offset" and "relativehumidity_offset" not in names.corrections_for(None) and len(names.corrections_for(None)) == 4
    cols = ["FLAG_L2_FC_SSITC_TEST", "FLAG_L2_FC_QCF", "FLAG_L2_LE_QCF", "FLAG_L33_NEE_CUT16_TEST", "FC"]
    assert names.flag_columns(cols, "NEE_1", ["CUT16"]) == cols[:2] and names.flag_columns(cols, "LE") == ["FLAG_L2_LE_QCF"] and names.flag_marks("x") == ("x",)
    assert names.base_variable("FC") == "CO2" and names.storage_column("LE") == "SLE_SINGLE" and names.storage_column("x") is None
    with pytest.raises(KeyError):
        names.base_variable("x")
    assert names.raw_test_inputs("FC", "CO2")["gas_completeness"] == ["EXPECT_NR", "CO2_NR"]
    assert names.stamp_convention("TIMESTAMP_END") == "end" and names.check_stamp_name("T", "end") == "T"
    with pytest.raises(ValueError, match="middle"):
        names.check_stamp_name("TIMESTAMP_MIDDLE", "end")
    assert names.repeated(["a", "b", "a"]) == {"a": 2} and names.id_suffix("x") == names.id_suffix("_x") == "_x" and names.id_suffix(None) == "" and names.with_tokens(["ab", "b"], ["a", "b"]) == ["ab"]
    assert names.event_flag("my  event") == "EVENT_my_event" and names.first_words("a b c", 2) == "a b"


def test_metadata_travels(spark, tmp_path):
    s = Store()
    s.original(["FC"], "read")
    s.derived("FC_1", "FC", "local sd", {"n": 3}, ["outliers"])
    s.derived("FC_2", "FC_1", "hampel")
    assert [x.operation for x in s.entry("FC_2").steps] == ["read", "local sd", "hampel"] and s.entry("FC_2").parents == ["FC_1", "FC"]
    s.adopt({"X": origin_note(parent="FC", operation="scale")})
    s.tag("FC", "mine")
    s.untag("FC_1", "outliers")
    assert "outliers" in s.entry("FC_1").tags and s.describe("FC", "w " * 80).count("w") == 50
    s.rename("FC", "FLUX")
    assert "FLUX" in s.entry("FC_1").parents
    with pytest.raises(ValueError, match="already"):
        s.rename("FLUX", "X")
    s.drop(["X"])
    assert "X" not in s and Store.from_dict(s.to_dict()).to_dict() == s.to_dict()
    s.attach(spark.createDataFrame([(1.0, 2.0)], "FLUX double, other double")).write.parquet(f"{tmp_path}/m")
    assert Store.of(spark.read.parquet(f"{tmp_path}/m")).to_dict() == {"FLUX": s.to_dict()["FLUX"]}


def test_files_and_layouts(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    (tmp_path / "a" / "b" / "x.csv").write_text("u1,u2\nDATE,TA,TA\n-,C,C\n2023-01-01 00:30,1,2\n")
    assert formats.find_files(str(tmp_path), "*.csv") == [str(tmp_path / "a" / "b" / "x.csv")] and formats.find_folders(str(tmp_path)) == [str(tmp_path / "a"), str(tmp_path / "a" / "b")]
    assert [p.split("/")[-1] for p in formats.find_remote(spark, str(tmp_path), "*.csv")] == ["x.csv"]
    layout = TextFormat("t", ("DATE",), "yyyy-MM-dd HH:mm", skip=1, header=2)
    assert formats.header(spark, str(tmp_path / "a" / "b" / "x.csv"), layout, 1) == (["DATE", "TA", "TA"], ["-", "C", "C"]) and formats.width(spark, str(tmp_path / "a" / "b" / "x.csv"), layout) == 3
    assert formats.fitted_header(["a", "a"], 3) == ["a", "a.1", "unknown-2"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.csv", "a\n1\n")
    assert open(formats.unzip(str(tmp_path / "z.zip"))).read() == "a\n1\n"
    d = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert formats.read_pickle(spark, formats.write_pickle(d, str(tmp_path / "p.pkl"))).collect()[0].b == 2.0 and pickle
    with pytest.raises(ValueError, match="parquet"):
        formats.write_pickle(d, str(tmp_path / "q.pkl"), 0)
    assert formats.checked_layout({"name": "t", "stamps": "D", "stamp_format": "yyyy", "delimiter": "-not-available-"}).stamps == ("D",)
    with pytest.raises(ValueError, match="layout"):
        formats.checked_layout({"what": 1})
    s = spark.createDataFrame([(datetime(2023, 1, 1, 0, 30), 1.5), (datetime(2023, 1, 1, 1, 0), None)], "ts timestamp_ntz, t double")
    r = formats.for_flux_processing(s, {"t": ("Ta", "C")}).collect()
    assert r[0].asDict() == {"TIMESTAMP_1|yyyy-mm-dd": "2023-01-01", "TIMESTAMP_2|HH:MM": "00:30", "Ta|C": 1.5} and r[1]["Ta|C"] == -9999
    assert formats.for_upload(s, {"t": "TA_1"}).first().TIMESTAMP_START == "202301010000" and formats.formatted_stamp(s, "T", "start", "HH:mm").first().T == "00:00"
    with pytest.raises(ValueError, match="half hours"):
        formats.for_flux_processing(s.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE")), {})
    assert formats.stamped(s, "TIMESTAMP_END").columns == ["TIMESTAMP_END", "t"] and not formats.is_project(spark, str(tmp_path)) and formats.out_path("a", "b", "csv") == "a/b.csv" and os.path.isdir(formats.make_folder(str(tmp_path / "new")))


def test_database_queries():
    assert influx.download_query("b", "2023-01-01", "2023-02-01", ["TA"], ["TA_1", "TA_2"], ["raw"]).split("\n") == [
        'from(bucket: "b")', "|> range(start: 2023-01-01, stop: 2023-02-01)", '|> filter(fn: (r) => r["_measurement"] == "TA")', '|> filter(fn: (r) => r["data_version"] == "raw")',
        '|> filter(fn: (r) => r["_field"] == "TA_1" or r["_field"] == "TA_2")', '|> pivot(rowKey:["_time"], columnKey: ["_field"], valueColumn: "_value")',
    ]
    assert 'schema.fieldKeys(bucket: "b", start: -9999d)' in influx.fields_of_bucket("b") and "measurementFieldKeys" in influx.fields_of_measurement("b", "TA") and "schema.measurements" in influx.measurements_of_bucket("b")
    if not influx.available():
        with pytest.raises(RuntimeError, match="client"):
            influx.Backend("u", "t", "o").buckets()


def test_files_with_other_headers(spark, tmp_path):
    """Columns in another order, and one that a file has not: each file is read by its own header; a row of data like another file's header stays a row."""
    from aeolith.sources import files

    (tmp_path / "a.csv").write_text("TIMESTAMP_END,TA,RH\n202301010030,1,50\n202301010100,2,51\n")
    (tmp_path / "b.csv").write_text("RH,TIMESTAMP_END,TA\n60,202301010130,3\n")
    (tmp_path / "c.csv").write_text("TIMESTAMP_END,TA\n202301010200,4\n")
    got = [tuple(r) for r in files.read_text(spark, f"file://{tmp_path}/*.csv", "csv_30min_end").orderBy("ts").select("TA", "RH").collect()]
    assert got == [(1.0, 50.0), (2.0, 51.0), (3.0, 60.0), (4.0, None)]


def test_columns(spark):
    from aeolith.operators import columns

    d = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0)], "ts int, b double, A double")
    with pytest.raises(ValueError, match="no such"):
        columns.keep(d, ["x"])
    assert columns.new_columns(d, d.select("ts", "b"), ["ts"]) == ["A"]
    with pytest.raises(ValueError, match="differ"):
        columns.new_columns(d, d.withColumn("b", F.lit(9.0)), ["ts"])
    two = columns.with_units(d, {"b": ("TA", "C")})
    assert two.columns == ["ts|-", "TA|C", "A|-"] and columns.flatten(two).columns == ["ts_-", "TA_C", "A_-"] and columns.flatten(two, True).columns == ["ts", "TA", "A"]
    with pytest.raises(ValueError, match="differ"):
        columns.flatten(columns.with_units(d, {"b": ("A", "C")}), True)
    assert columns.ordered(d.withColumn(".z", F.lit(1)), ("ts",)).columns == [".z", "ts", "A", "b"] and columns.rename(d, {"b": "c"}).columns == ["ts", "c", "A"]
    y, x, names_, ts = columns.to_arrays(d, "A")
    assert y.tolist() == [3.0] and x.tolist() == [[2.0]] and names_ == ["b"] and ts.tolist() == [1]
    s = columns.made_series(spark, 5000).toPandas()
    assert abs(s.noise.std() - 2) < 0.1 and abs(s.noise.mean()) < 0.1 and 0.01 < ((s.observed_value - s.base_signal - s.noise).abs() > 1e-9).mean() < 0.03
    n = columns.impulse_noise(spark.createDataFrame([("a", i, 1.0 + i % 5) for i in range(2000)], "k string, ts int, v double"), ["k"]).toPandas()
    moved = (n.noisy != n.v).mean()
    assert 0.02 < moved < 0.06 and (n.noisy - n.v).between(-10, 50).all()


def test_stamps_of_ends_and_numbers(spark):
    from aeolith.functions import meteo
    from aeolith.operators import timeaxis

    rows = [("a", T0 + timedelta(minutes=10 * i)) for i in range(40)] + [("b", T0 + timedelta(minutes=10 * i + (i == 5))) for i in range(40)] + [("c", T0 + timedelta(minutes=10 * i if i < 20 else 30 * i)) for i in range(40)]
    got = {r.k: (r.step, r.n) for r in timeaxis.frequency_of_ends(frame(spark, rows, "k string, ts timestamp_ntz"), ["k"]).collect()}
    assert got == {"a": (600, 20), "b": (600, 5), "c": (None, None)}
    d = timeaxis.stamps_by_number(spark.range(100).withColumn("k", F.lit("a")), ["k"], "id", "2023-01-01", 0.05, 5.0).orderBy("id").collect()
    assert d[3].ts == datetime(2023, 1, 1, 0, 0, 0, 150_000) and timeaxis.seconds_of(2, "h") == 7200 and timeaxis.unix_now() > 1_600_000_000
    assert meteo.mds_description(0) == "measured" and meteo.mds_description(1014).endswith("14 d window (quality 1)") and meteo.mds_description(3007).endswith("(quality 3)")
    m, s, n = meteo.mean_sd_count(F.col("x"), 3)
    assert tuple(frame(spark, [(1.0,), (2.0,), (None,)], "x double").agg(m, s, n).first()) == (None, None, 2)


def test_exact_quantiles_cell_by_cell(spark, monkeypatch):
    from aeolith.operators import binning

    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(size=5000).round(3), np.full(2000, 0.5), [None] * 10]
    d = frame(spark, [(None if v is None else float(v),) for v in x.tolist()], "x double").repartition(5)
    shares = [0.0, 0.001, 0.1, 0.3333, 0.5, 0.77, 0.999, 1.0]
    want = d.agg(F.percentile("x", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert np.allclose(binning.exact_quantiles(d, "x", shares, 50), want) and binning.exact_quantiles(d.where("x > 100"), "x", shares) == []
    one = binning.quantile_edges(d, [], "x", 10).first().edges
    monkeypatch.setattr(binning, "DISTINCT", 10)
    assert np.allclose(binning.quantile_edges(d, [], "x", 10).first().edges, one)


def test_uncertainty_cascade_by_brute_force(spark):
    rng, rows = np.random.default_rng(12), []
    for i in range(48 * 40):
        h = i % 48 / 2
        x = None if rng.random() < 0.3 or 20 * 48 < i < 23 * 48 else float(5 * np.sin((h - 6) * np.pi / 12) + rng.normal(0, 0.5))
        rows.append(("a", T0 + timedelta(minutes=30 * i), x, float(10 + 5 * np.sin(h)), float(5 + i % 3), float(max(0, 400 * np.sin((h - 6) * np.pi / 12))), x if x is not None else (60.0 if i == 100 else float(rng.normal(0, 9)))))
    d = frame(spark, rows, "k string, ts timestamp_ntz, flux double, ta double, vpd double, swin double, filled double")
    got = {r.ts: r for r in flux.uncertainty_cascade(d, ["k"]).collect()}
    first = {r.ts: r.uncertainty for r in flux.random_uncertainty(d, ["k"]).collect()}
    known = [(r[1], r[6], first[r[1]]) for r in rows if first[r[1]] is not None]
    for r in rows:
        u, m = got[r[1]].uncertainty, got[r[1]].method
        if first[r[1]] is not None:
            assert m == 1 and abs(u - first[r[1]]) < 1e-9
            continue
        alike = [(t, y) for t, x, y in known if abs(x - r[6]) <= max(2.0, 0.2 * abs(r[6]))]
        near = [y for t, y in alike if abs((t - r[1]).total_seconds()) <= 14 * 86400]
        if near or alike:
            assert m == (2 if near else 3) and abs(u - np.median(near or [y for _, y in alike])) < 1e-9
        else:
            assert m in (4, None)
    assert got[rows[100][1]].method == 4 and {r.method for r in got.values()} >= {1, 2, 4}
