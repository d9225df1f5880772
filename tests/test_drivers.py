"""Importances against the model asked by hand, and how often it is trained and asked."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import functions as F

from aeolith.operators import drivers, forests
from aeolith.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (700, 4)).astype(float)
    rows = [(float(5 * a + 2 * b * c + rng.normal()), float(a), float(b), float(c), float(e)) for a, b, c, e in x]
    return spark.createDataFrame([*rows, (1.0, None, 2.0, 3.0, 4.0)], "y double, a double, b double, c double, e double").withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id())).cache()


def by_hand(spark, model, d, names, orders=8):
    """Each order of drivers for each row, one question at a time."""
    rows = drivers._with_partner(d.dropna().withColumn("_y", F.col("y")).select("_y", *names), names, 42).collect()
    own, other = (np.array([r[c] for r in rows]) for c in ("_own", "_b"))
    rng, phi = random.Random(42), np.zeros(own.shape)
    for way in [rng.sample(range(len(names)), len(names)) for _ in range(orders)]:
        now, answers = other.copy(), []
        for i in (None, *way):
            if i is not None:
                now[:, i] = own[:, i]
            asked = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(now)], ["k", *names])
            answers.append(np.array([r[0] for r in model.transform(drivers._vector(asked, names)).orderBy("k").select("_p").collect()]))
        for k, i in enumerate(way):
            phi[:, i] += (answers[k + 1] - answers[k]) / orders
    return dict(zip(names, np.abs(phi).mean(0), strict=True))


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_importance_by_hand_asking_each_set_once(spark, table, kind, monkeypatch):
    names, asked = ["a", "b", "c", "e"], []
    model = drivers._model(kind, 42).fit(drivers._vector(table.dropna().withColumn("_y", F.col("y")), names))
    want = by_hand(spark, model, table, names, 4)
    for t in (RandomForestRegressionModel, GBTRegressionModel):
        monkeypatch.setattr(t, "transform", lambda self, d, f=t.transform: asked.append(d.count()) or f(self, d))
    for most, rows in ((drivers.GRID_CELLS, 0), (1, 2**4 * 700)):
        monkeypatch.setattr(drivers, "GRID_CELLS", most)
        got = drivers.Drivers(table, "y", names).importance(table, model, names, 4).collect()
        assert sum(asked) <= rows
        assert all(abs(r.importance - want[r.driver]) < 1e-9 * max(want.values()) for r in got)
        assert [r.driver for r in sorted(got, key=lambda r: r["rank"])] == sorted(names, key=lambda c: -want[c])


def test_importance_of_no_rows_and_of_a_model_without_splits(spark, table):
    flat = table.withColumn("y", F.lit(3.0))
    model = drivers._model("rf", 42).fit(drivers._vector(flat.dropna().withColumn("_y", F.col("y")), ["a", "b"]))
    assert [r.importance for r in drivers.Drivers(flat, "y", ["a", "b"]).importance(flat, model).collect()] == [0.0, 0.0]
    assert [r.importance for r in drivers.Drivers(flat, "y", ["a", "b"]).importance(flat.where("a > 99"), model).collect()] == [None, None]
    with pytest.raises(ValueError, match="no complete records"):
        drivers.Drivers(table.where("a IS NULL"), "y", ["a", "b"]).shap()


def test_driver_importance_trains_one_model_and_that_in_one_pass(spark, table, monkeypatch):
    trained = []
    monkeypatch.setattr(drivers, "_model", lambda *a, f=drivers._model: trained.append(a) or f(*a))
    assert {r.driver for r in registry.queries()["driver_importance"](spark, "/root/testdata/sf0.001").collect()} == {"quantity", "l_discount", "l_tax"}
    assert not trained  # its drivers are coarse
    for n, (kind, cells) in enumerate((("gbt", forests.CELLS), ("rf", 8)), 1):  # other models, and drivers that aren't coarse
        monkeypatch.setattr(forests, "CELLS", cells)
        t = {r.driver: r for r in drivers.Drivers(table, "y", ["a", "b", "c"], kind=kind).shap().result.tables["shap"].collect()}
        assert len(trained) == n and all(t[c].relevant for c in t)


def test_forest_of_one_driver_has_the_means_of_its_cells(spark):
    d = spark.createDataFrame([(float(i % 5), float((i % 5) ** 2 + 1e6)) for i in range(400)], "a double, _y double").repartition(3)
    g = forests.coarse_forest(d, ["a"], 1)
    assert g.splits[0].tolist() == [0.0, 1.0, 2.0, 3.0] and np.allclose(g.table, [1e6, 1e6 + 1, 1e6 + 4, 1e6 + 9, 1e6 + 16], rtol=0, atol=1e-6)


def test_forest_is_as_good_as_mllibs(spark, table):
    names, d = ["a", "b", "c", "e"], table.dropna().withColumn("_y", F.col("y"))
    rows = d.select("y", *names).toPandas()
    own, again, other = forests.coarse_forest(d, names, 7), forests.coarse_forest(d, names, 7), drivers._grid(drivers._model("rf", 7).fit(drivers._vector(d, names)), 4)
    assert (own.table == again.table).all() and (own.table != forests.coarse_forest(d, names, 8).table).any()
    error = [np.mean((g.table[tuple(np.searchsorted(x, rows[c].to_numpy()) for x, c in zip(g.splits, names, strict=True))] - rows.y) ** 2) for g in (own, other)]
    assert error[0] < 1.25 * error[1] and error[0] < 0.25 * rows.y.var()
    x, y = (drivers.Drivers(table, "y", names).importance(table, m, names).collect() for m in (own, other))
    assert {r.driver: r["rank"] for r in x if r["rank"] < 4} == {r.driver: r["rank"] for r in y if r["rank"] < 4}


def test_forest_draws_each_record_for_each_tree(spark):
    d = spark.range(3000, numPartitions=3).select(F.lit(1.0).alias("_y"), (F.col("id") % 4).cast("double").alias("a"))
    sums = d.mapInArrow(forests._drawn([np.array([0.0, 1.0, 2.0])], 0.0, 20, 3), "tree int, at int, part int, w binary, s binary").collect()
    w = np.zeros((20, 4))
    for r in sums:
        assert r.w == r.s
        w[r.tree] += np.frombuffer(r.w)
    assert len(np.unique(w, axis=0)) == 20 and abs(w - 750).max() < 6 * 750**0.5 and 0.5 < w.var() / 750 < 2  # Poisson: variance as the mean


def test_forest_grows_as_by_trying_all_splits():
    rng = np.random.default_rng(3)
    w, s = rng.poisson(2.0, 12).astype(float), rng.normal(0, 3, 12)
    s[w == 0] = 0.0

    def by_hand(cells, depth):
        total, sides = w[cells].sum(), []
        for j in cells[:-1]:
            a, b = cells[cells <= j], cells[cells > j]
            if w[a].sum() and w[b].sum():
                sides.append((s[a].sum() ** 2 / w[a].sum() + s[b].sum() ** 2 / w[b].sum(), a, b))
        if not depth or not sides:
            return dict.fromkeys(cells.tolist(), s[cells].sum() / total)
        _, a, b = max(sides, key=lambda x: x[0])
        return by_hand(a, depth - 1) | by_hand(b, depth - 1)

    for depth in (0, 1, 3):
        want = by_hand(np.arange(12), depth)
        assert np.allclose(forests.grower((12,), depth)(w, s, rng), [want[i] for i in range(12)])


def test_forest_splits(spark):
    d = spark.range(20000).select(F.lit(1.0).alias("_y"), F.col("id").cast("double").alias("many"), F.when(F.col("id") < 200, 1.0).when(F.col("id") < 400, 2.0).otherwise(0.0).alias("rare"), F.lit(3.0).alias("one"))
    (many, rare, one), mean, n = forests._splits(d, ["many", "rare", "one"], 32)
    assert len(many) == 31 and np.abs(np.diff(many) - 625).max() < 30 and rare.tolist() == [0.0, 1.0] and not len(one) and (mean, n) == (1.0, 20000)
