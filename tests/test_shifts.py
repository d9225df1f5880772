"""Planted clock errors and offsets come back."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from aeolith.operators import quality, shifts, stats

T0 = datetime(2023, 6, 1)


def days(spark):
    rows = [("a", T0 + timedelta(minutes=30 * i), float(max(0.0, 800 * np.sin((i % 48 / 2 - 5) * np.pi / 14)))) for i in range(48 * 6)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, p double")
    return d.withColumn("m", 0.8 * F.lag("p", 3).over(Window.partitionBy("k").orderBy("ts")))


def test_planted_shift(spark):
    d = days(spark)
    phase = [r.minutes for r in shifts.phase_shift(d, ["k"], "m", "p").where("day > '2023-06-01'").collect()]
    assert len(phase) == 5 and all(abs(x - 90) < 1 for x in phase)
    assert {r.lag for r in shifts.lag_shift(d, ["k"], "m", "p").where("day > '2023-06-01' AND day < '2023-06-06'").collect()} == {3}
    assert {r.minutes for r in shifts.noon_shift(d, ["k"], "m", "p").where("day > '2023-06-01'").collect()} == {90.0}


def test_planted_turn(spark):
    rng = np.random.default_rng(1)
    base = np.concatenate([rng.normal(80, 15, 4000), rng.normal(230, 30, 3000)]) % 360
    rows = [(datetime(2020, 1, 1), float(x)) for x in base] + [(datetime(2021, 1, 1), float((x - 25) % 360)) for x in base]
    got = {r.year: r.offset for r in shifts.wind_direction_offset(spark.createDataFrame(rows, "ts timestamp_ntz, wd double"), "wd", [2020]).collect()}
    assert got == {2020: 0, 2021: 25}


def test_overview_and_report(spark):
    d = spark.createDataFrame([(T0, 1.0), (T0, 1.0), (T0 + timedelta(days=1), None)], "ts timestamp_ntz, v double")
    r = stats.overview(d).first()
    assert (r.rows, r.columns, r.cells, r.missing_cells, r.repeated_stamps, r.repeated_rows) == (3, 2, 6, 1, 1, 1)
    d = spark.createDataFrame([("a", 1.0, 2, 2), ("a", 2.0, 0, 2), ("a", 3.0, 0, None), ("a", None, 2, 2)], "k string, v double, f int, g int")
    assert [(r.test, r.newly_rejected, r.retained) for r in quality.screening_report(d, "v", ["f", "g"], ["k"]).collect()] == [("f", 1, 2), ("g", 1, 1)]
