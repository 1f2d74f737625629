"""Forests, stumps and exact Shapley values against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import forest as fo
from quarry.operators.learners import KNNClassifier
from quarry.operators.stumps import AdaBoostClassifier, boost
from quarry.operators.tree_shap import tree_shap

RNG = np.random.default_rng(0)
N, P = 240, 5
X = RNG.integers(0, 25, (N, P)).astype(float)
CLASSES = ((X[:, 0] > 12) ^ (X[:, 1] > 9)).astype(int) + (X[:, 2] > 20)
TARGET = X[:, 0] * 3 + X[:, 1] ** 2 + RNG.integers(0, 5, N)


@pytest.fixture(scope="module")
def tables(spark):
    return {k: fo.stored_rows(spark.createDataFrame(
        [(i, -1, i % 7 == 0, X[i].tolist(), float(y[i]), 1.0) for i in range(N)], fo.ROWS))
        for k, y in ((3, CLASSES), (0, TARGET))}


def _nodes(df):
    return sorted((r.t, r.node, r.depth, r.f, round(r.cut, 9), r.lo, r.hi, [round(v, 6) for v in r.stats]) for r in df.collect())


@pytest.mark.parametrize("kind,classes", [("extra", 3), ("forest", 0), ("tree", 3)])
def test_trees_do_not_depend_on_where_they_grow(spark, tables, kind, classes):
    g = fo.Grower(kind, classes, 1 if kind == "tree" else 3, 0, 1, P if kind == "tree" else 2)
    whole = fo.grow_forests(tables[classes], [g])
    levels = fo.grow_forests(tables[classes], [g], handoff=60)
    assert _nodes(whole) == _nodes(levels) and levels.where("sub = 0").count() > 1
    a, b = ({r.rid: [round(v, 9) for v in r.value] for r in fo.held_out_values(tables[classes], n, [g]).collect()}
            for n in (whole, levels))
    assert a == b and len(a) == len(range(0, N, 7))
    for handoff in (fo.HANDOFF, 60):
        c = fo.cross_values(tables[classes], [g], handoff).collect()
        assert {r.rid: [round(v, 9) for v in r.value] for r in c} == a
    want = fo.Packed(whole.toArrow(), classes, 0.0).predict(X[::7])
    assert np.allclose([a[i] for i in range(0, N, 7)], want)


def test_single_tree_is_the_greedy_tree(spark, tables):
    """Every split is the best of all cuts; leaves are pure or cannot be split."""
    tree = fo.Packed(fo.grow_forests(tables[3], [fo.Grower("tree", 3, 1, 0, 1, P)]).toArrow(), 3, 0.0)
    learn = np.arange(N) % 7 != 0

    def gini(y):
        return len(y) - (np.bincount(y, minlength=3) ** 2).sum() / len(y) if len(y) else 0.0

    def walk(at, rows):
        y = CLASSES[rows]
        if tree.f[at] < 0:
            assert len(set(y)) == 1 or len(np.unique(X[rows], axis=0)) == 1
            return
        low = X[rows, tree.f[at]] <= tree.cut[at]
        best = min(gini(y[X[rows, f] <= c]) + gini(y[X[rows, f] > c])
                   for f in range(P) for c in np.unique(X[rows, f])[:-1])
        assert math.isclose(gini(y[low]) + gini(y[~low]), best, abs_tol=1e-9)
        walk(tree.child[at, 0], rows[low])
        walk(tree.child[at, 1], rows[~low])
    walk(int(tree.start[0]), np.flatnonzero(learn))


def _frame(spark, y):
    return spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(N)], "id int, x array<double>, label double"
                                 ).withColumn("features", array_to_vector("x"))


def test_saved_models_carry_their_tables(spark, tmp_path, monkeypatch):
    df = _frame(spark, CLASSES)
    for est in (fo.ForestClassifier(numTrees=3), KNNClassifier(k=3), AdaBoostClassifier(numRounds=3)):
        model = PipelineModel(stages=[est.fit(df)])
        want = {r.id: r.prediction for r in model.transform(df).collect()}
        model.write().save(f"{tmp_path}/{type(est).__name__}")
        (tmp_path / type(est).__name__).rename(tmp_path / f"moved {type(est).__name__}")
        again = PipelineModel.load(f"{tmp_path}/moved {type(est).__name__}")
        for name in ("nodesPath", "trainPath"):  # nothing outside the folder is read
            if again.stages[0].hasParam(name):
                assert str(tmp_path) in again.stages[0].getOrDefault(name)
        assert {r.id: r.prediction for r in again.transform(df).collect()} == want
        if hasattr(est, "kind"):  # a forest too large to be sent to every task scores part by part
            monkeypatch.setattr(fo, "BROADCAST_BYTES", 0)
            assert {r.id: r.prediction for r in again.transform(df).collect()} == want
            monkeypatch.undo()


def test_repeated_vector_and_constant_target(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], float(i % 2)) for i in range(50)], "id int, x array<double>, label double"
                                 ).withColumn("features", array_to_vector("x"))
    out = fo.ForestClassifier(kind="tree").fit(same).transform(same)
    assert {tuple(r.probability) for r in out.collect()} == {(0.5, 0.5)}
    flat = same.withColumn("label", F.lit(3.0))
    assert {r.prediction for r in fo.ForestRegressor(numTrees=2).fit(flat).transform(flat).collect()} == {3.0}


def test_stumps_are_the_best_of_all_cuts(spark, tables):
    stumps, alphas = boost(tables[3], {-1: 3}, 6)[-1]
    keep = np.arange(N) % 7 != 0
    x, y = X[keep], CLASSES[keep]
    w = np.ones(len(y))
    for (f, cut, low, high), alpha in zip(stumps, alphas):
        best = None
        for j, c in itertools.chain.from_iterable(((j, (a + b) / 2) for a, b in itertools.pairwise(np.unique(x[:, j]))) for j in range(P)):
            a, b = (np.bincount(y[s], w[s], 3) for s in (x[:, j] <= c, x[:, j] > c))
            loss = round((a.sum() - (a ** 2).sum() / a.sum() + b.sum() - (b ** 2).sum() / b.sum()) / w.sum(), 12)
            if best is None or loss < best[0]:
                best = (loss, j, c, int(a.argmax()), int(b.argmax()), a.sum() - a.max() + b.sum() - b.max())
        assert (f, cut, low, high) == best[1:5]
        err = best[5] / w.sum()
        assert math.isclose(alpha, math.log((1 - err) / err) + math.log(2))
        w = w * np.exp(alpha * (np.where(x[:, f] <= cut, low, high) != y))


@pytest.mark.parametrize("classes", [3, 0])
def test_shapley_values_equal_the_sum_over_subsets(spark, classes):
    df = _frame(spark, CLASSES if classes else TARGET)
    est = fo.ForestClassifier(numTrees=2, handoff=60) if classes else fo.ForestRegressor(numTrees=2, maxDepth=6)
    model = est.fit(df)
    some = df.where("id < 4")
    rows = tree_shap(model, some, "id", [f"f{i}" for i in range(P)]).collect()
    got, base = {(r.id, r.feature): r.contribution for r in rows}, rows[0]["base"]
    tree = fo.Packed(model.nodes().toArrow(), classes, model.getOrDefault(model.center))

    def expected(x, known):
        def walk(at):
            if tree.f[at] < 0:
                return tree.value[at, 1 if classes else 0]
            low, high = tree.child[at]
            if tree.f[at] in known:
                return walk(low if x[tree.f[at]] <= tree.cut[at] else high)
            return (walk(low) * tree.cover[low] + walk(high) * tree.cover[high]) / tree.cover[at]
        return sum(walk(int(s)) for s in tree.start) / len(tree.start)
    for i in range(4):
        value = {s: expected(X[i], s) for k in range(P + 1) for s in itertools.combinations(range(P), k)}
        assert math.isclose(base, value[()], rel_tol=1e-9)
        for f in range(P):
            want = sum(math.factorial(len(s)) * math.factorial(P - len(s) - 1) / math.factorial(P)
                       * (value[tuple(sorted((*s, f)))] - v) for s, v in value.items() if f not in s)
            assert math.isclose(got[i, f"f{f}"], want, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(base + sum(got[i, f"f{f}"] for f in range(P)), value[tuple(range(P))], rel_tol=1e-9, abs_tol=1e-9)


def test_no_value_of_a_large_table_is_rounded(spark):
    rows = spark.range(0, 66_000, 1, 4).selectExpr("id rid", "-1 store", "false held", "array(id / 7D, id % 3D) x", "id % 5D y", "1D w")
    assert fo.stored_rows(rows).select(F.col("x")[0]).distinct().count() == 66_000


@pytest.mark.parametrize("kind,classes", [("tree", 0), ("forest", 2)])
def test_large_nodes_find_the_cuts_between_all_values(spark, monkeypatch, kind, classes):
    """Ranges that hold many values are opened where they may hold the best cut, also of targets that are not whole."""
    monkeypatch.setattr(fo, "BUCKETS", 8)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 2, 900), rng.random(900) * 100])
    y = np.round(x[:, 2] * 1.37 + 9 * np.sin(5 * x[:, 0]) + rng.normal(size=900) + 1e4, 2)
    y = (y > np.median(y)).astype(float) if classes else y
    df = spark.createDataFrame([(i, -1, False, x[i].tolist(), float(y[i]), 1.0) for i in range(900)], fo.ROWS).repartition(2).checkpoint()
    g = fo.Grower(kind, classes, 1, 0, 3, 2 if classes else 3, 42, -1, *((0.0, 1.0) if classes else fo.target_steps(y.min(), y.mean(), y.max())))
    whole, levels = (sorted((r.t, r.node, r.depth, r.f, r.cut, r.lo, r.hi) for r in fo.grow_forests(df, [g], n).collect()) for n in (1000, 300))
    assert whole == levels and len(whole) > 40


def test_sorted_rows_find_the_best_of_all_cuts():
    """Ties between features go to the one drawn first, though targets are not whole."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=60)
    x = np.column_stack([base, -base, base ** 3, rng.integers(0, 2, 60), np.round(base)])
    y, bag = np.round(rng.random(60) * 1e5, 2), rng.integers(1, 4, 60).astype(float)
    for w in (np.ones(60), bag):
        g = fo.Grower("forest", 0, 1, 0, 1, 5, 42, -1, *fo.target_steps(y.min(), y.mean(), y.max()))
        nodes = fo.grow(g, 0, [0], [g.root(0)], x, g.stats(y, w), np.zeros(60, np.int64), 0, g.steps(y, w)).to_pylist()

        def walk(node, rows):
            if node["f"] < 0:
                assert len(rows) == 1
                return
            def loss(r):
                return (w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum() if len(r) else 0.0
            cuts = [(round((loss(rows[x[rows, f] <= c]) + loss(rows[x[rows, f] > c])) / loss(rows), 9), k) for k, f in enumerate(
                g.candidates(np.array([node["node"]]), np.array([[len(set(x[rows, f])) > 1 for f in range(5)]]))[0])
                for c in np.unique(x[rows, f])[:-1]]
            low = x[rows, node["f"]] <= node["cut"]
            assert math.isclose((loss(rows[low]) + loss(rows[~low])) / loss(rows), min(cuts)[0], abs_tol=1e-8)
            drawn = g.candidates(np.array([node["node"]]), np.array([[len(set(x[rows, f])) > 1 for f in range(5)]]))[0].tolist()
            assert drawn.index(node["f"]) == min(cuts)[1]
            by = {n["node"]: n for n in nodes}
            walk(by[node["lo"]], rows[low])
            walk(by[node["hi"]], rows[~low])
        walk(next(n for n in nodes if n["depth"] == 0), np.arange(60))


def test_few_rows_are_sent_to_the_nodes_of_a_large_forest(spark, monkeypatch):
    """A forest too large to be sent to every task scores rows that are not, through levels and whole trees alike."""
    df = _frame(spark, CLASSES)
    for est in (fo.ForestClassifier(numTrees=3, handoff=60), fo.ForestClassifier(numTrees=3)):
        model = est.fit(df)
        want = {r.id: r.probability.toArray().round(9).tolist() for r in model.transform(df).collect()}
        monkeypatch.setattr(fo, "packed_bytes", lambda nodes: fo.BROADCAST_BYTES + 1)
        monkeypatch.setattr(fo, "_asked_batch", None)  # the rows are not dealt out tree by tree
        assert {r.id: r.probability.toArray().round(9).tolist() for r in model.transform(df).collect()} == want
        monkeypatch.undo()
