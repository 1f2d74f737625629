"""Work is spread over tasks and passes are shared, with unchanged results."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import eda as ed
from quarry.operators import forest as fo
from quarry.operators import models as md
from quarry.operators.features import engineer_features


def test_one_large_part_is_dealt_over_tasks(spark):
    from quarry.session import stored

    df = spark.range(0, 45_000, 1, 1)
    assert stored(df).rdd.getNumPartitions() == 3
    assert stored(df).agg(F.sum("id")).first()[0] == 45_000 * 44_999 // 2
    assert [r.id for r in stored(spark.range(0, 100, 1, 1)).collect()] == list(range(100))


def test_features_of_one_large_part_are_made_in_many_tasks(spark):
    df = spark.range(0, 45_000, 1, 1).select((F.col("id") % 97).cast("double").alias("a"),
                                             (F.col("id") % 13).cast("double").alias("b"), F.lit(0).alias("y"))
    assert engineer_features(df, "y").data.rdd.getNumPartitions() == 3


def test_kmeans_caches_no_table(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("cached")
    monkeypatch.setattr(DataFrame, "cache", refuse)
    df = spark.createDataFrame([([float(v)],) for v in (1, 2, 100, 101)], "x array<double>").select(
        array_to_vector("x").alias("features"))
    centres = sorted(float(c[0]) for c in md.kmeans_best_of(df, k=2, n_init=2).clusterCenters())
    assert centres == [1.5, 100.5]


def test_pearson_of_offset_constant_and_null_columns(spark):
    rows = [(1e9 + i, 1e9 - 2 * i + (i % 3), 0.1, None if i == 4 else float(i * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in ed.pearson_matrix(df).collect()}
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert math.isclose(m["a", "b"], np.corrcoef(a, b)[0, 1], abs_tol=1e-6)
    assert m["a", "c"] is None and m["c", "c"] is None and m["d", "a"] == m["a", "d"] > 0.9


def test_known_means_spare_a_pass(spark, monkeypatch):
    seen = []
    real = ed.pairwise_pearson
    monkeypatch.setattr(ed, "pairwise_pearson", lambda *a: seen.append(a[3]) or real(*a))
    df = spark.createDataFrame([(1.0, 9.0), (2.0, 9.0), (3.0, 5.0), (4.0, 1.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in ed.spearman_matrix(df).collect()}
    assert seen == [[2.5, 2.5]] and m["a", "b"] == round(-0.9486832980505138, 6)


def test_levels_do_not_write_the_rows_again(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(1)
    rows = [(i, -1, False, [float(v) for v in rng.normal(size=3)], float(rng.integers(-9, 9)), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, fo.ROWS).repartition(1).checkpoint(eager=True)
    written, real = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: written.append(self.columns) or real(self, eager))
    g = fo.Grower("tree", 0, 1, features=3)
    levels = fo.grow_forests(df, [g], handoff=50)
    assert not [c for c in written if "x" in c]
    assert levels.rdd.getNumPartitions() > 3  # the small nodes are finished by several tasks
    key = ["t", "node", "depth", "f", "cut"]
    whole = fo.grow_forests(df, [g], handoff=1000)
    assert {tuple(r) for r in levels.select(key).collect()} == {tuple(r) for r in whole.select(key).collect()}


def test_settings_go_through_the_levels_together(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(2)
    rows = [(i, 0, i % 5 == 0, [float(v) for v in rng.integers(0, 40, 4)], float(rng.integers(0, 2)), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, fo.ROWS).repartition(3).checkpoint(eager=True)
    calls, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: calls.append(f.__name__) or real(self, f, *a, **k))
    settings = [fo.Grower("tree", 2, 1, depth, least, 4, store=0) for depth in (0, 3) for least in (1, 4)]
    values = fo.cross_values(df, settings, handoff=80).collect()
    together, calls[:] = list(calls), []
    fo.cross_values(df, settings[:1], handoff=80)
    assert together == calls  # four settings take the passes of one
    for job, g in enumerate(settings):
        alone = {r.rid: r.value for r in fo.cross_values(df, [g], handoff=1000).collect()}
        assert {r.rid: r.value for r in values if r.job == job} == alone and len(alone) == 80


def test_splits_by_drawn_candidates_are_the_best_splits():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, k, 600) for k in (2, 2, 3, 9, 50, 400)]) / 4 - 1
    y, bag = rng.integers(0, 3, 600), rng.integers(1, 4, 600).astype(float)
    g = fo.Grower("forest", 3, 1, features=2)
    node = np.sort(rng.integers(0, 7, 600))
    x[node == 2, :5] = 0  # one candidate only
    varies = np.array([[len(set(x[node == i, f])) > 1 for f in range(6)] for i in range(7)])
    stats = g.stats(y, bag)
    total = fo._sums(stats, np.arange(600), node, 7)
    pick = g.candidates(np.arange(1, 8) * 12345, varies)
    f, cut, share = fo._best_splits(g, *fo._ranked(x), stats, np.arange(600), node, pick, varies, total)
    for i in range(7):
        best = (np.inf, -1, 0.0)
        for j in pick[i][varies[i, pick[i]]]:
            v = np.unique(x[node == i, j])
            for low, high in zip(v, v[1:]):
                left = stats[(node == i) & (x[:, j] <= low)].sum(axis=0)
                loss = float(g.relative(left, total[i]))
                best = min(best, (loss, int(j), float(low + (high - low) / 2)), key=lambda b: b[0])
        assert best == (share[i], f[i], cut[i])
