"""Boosted decision stumps (SAMME) over all cuts of every feature.

A round is one job for all stores (folds) at once: every task works out its
rows' weights from the stumps so far (a short list), sums class weights per
(store, feature, value) before the shuffle, and each (store, feature) group
turns its sums into running sums and keeps its best cut. The driver receives
one row per store and feature and picks the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.forest import Grower, _matrix, _middle, forest_rows
from quarry.operators.learners import _ClassifierParams, _features_array, _score_outputs
from quarry.session import ship_package

Stump = tuple[int, float, int, int]  # feature, cut, class up to the cut, class above it


def vote(x: np.ndarray, stump: Stump) -> np.ndarray:
    f, cut, low, high = stump
    return np.where(x[:, f] <= cut, low, high)


def row_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, stumps: Sequence[Stump], alphas: Sequence[float]) -> np.ndarray:
    """Weights after the given rounds: a row grows by ``exp(alpha)`` for every stump that was wrong on it."""
    power = np.zeros(len(y))
    for s, a in zip(stumps, alphas):
        power += a * (vote(x, s) != y)
    return w * np.exp(power)


def best_cut(g: Grower, v: np.ndarray, mass: np.ndarray) -> tuple[float, float, int, int, float] | None:
    """Cut of lowest weighted impurity over sorted distinct values: ``loss, cut, classes of the sides, wrong weight``."""
    if len(v) < 2:
        return None
    stats = np.column_stack([mass, np.ones(len(v))])
    total = stats.sum(axis=0)
    left = np.cumsum(stats, axis=0)[:-1]
    share = np.round((g.loss(left) + g.loss(total - left)) / max(total[:-1].sum(), 1e-300), 12)
    i = int(np.argmin(share))
    a, b = left[i, :-1], (total - left[i])[:-1]
    return float(share[i]), float(_middle(v[i], v[i + 1])), int(a.argmax()), int(b.argmax()), float(
        a.sum() - a.max() + b.sum() - b.max())


def boost(rows: DataFrame, classes: dict[int, int], rounds: int) -> dict[int, tuple[list[Stump], list[float]]]:
    """Stumps and their weights per store of ``rows`` (stored, shape ``forest.ROWS``); held rows are left out."""
    ship_package(rows.sparkSession)
    learn = rows.where(~F.col("held") & F.col("store").isin(list(classes)))
    done: dict[int, tuple[list[Stump], list[float]]] = {s: ([], []) for s in classes}
    going = set(classes)
    width = max(classes.values())
    names = [f"c{i}" for i in range(width)]
    for _ in range(rounds):
        state = {s: done[s] for s in going}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                store = b["store"].to_numpy()
                for s in np.unique(store):
                    if s not in state:
                        continue
                    mine = b.filter(pa.array(store == s))
                    x, y = _matrix(mine["x"]), mine["y"].to_numpy().astype(int)
                    w = row_weights(x, y, mine["w"].to_numpy(), *state[s])
                    for f in range(x.shape[1]):
                        v, at = np.unique(x[:, f], return_inverse=True)
                        mass = np.zeros((len(v), width))
                        np.add.at(mass, (at, y), w)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(v), s, np.int32)), pa.array(np.full(len(v), f, np.int32)), pa.array(v),
                             *[pa.array(mass[:, c]) for c in range(width)]], names=["store", "f", "v", *names])

        def best(table: pa.Table) -> pa.Table:
            s, f = table["store"][0].as_py(), table["f"][0].as_py()
            v = table["v"].to_numpy()
            order = np.argsort(v)
            mass = np.column_stack([table[c].to_numpy() for c in names])[order]
            cut = best_cut(Grower("tree", width), v[order], mass)
            row = {"store": [s], "f": [f], "loss": [None], "cut": [None], "low": [None], "high": [None], "wrong": [None],
                   "total": [float(mass.sum())]}
            if cut:
                row |= {k: [c] for k, c in zip(("loss", "cut", "low", "high", "wrong"), cut)}
            return pa.table(row, schema=pa.schema(
                [("store", pa.int32()), ("f", pa.int32()), ("loss", pa.float64()), ("cut", pa.float64()),
                 ("low", pa.int32()), ("high", pa.int32()), ("wrong", pa.float64()), ("total", pa.float64())]))

        counted = learn.mapInArrow(sums, "store int, f int, v double, " + ", ".join(f"{n} double" for n in names))
        found = counted.groupBy("store", "f", "v").agg(*[F.sum(n).alias(n) for n in names]).groupBy("store", "f").applyInArrow(
            best, "store int, f int, loss double, cut double, low int, high int, wrong double, total double").collect()
        for s in sorted(going):
            cuts = [r for r in found if r["store"] == s and r["loss"] is not None]
            if not cuts:
                going.discard(s)
                continue
            r = min(cuts, key=lambda c: (c["loss"], c["f"]))
            err, k = r["wrong"] / r["total"], classes[s]
            stumps, alphas = done[s]
            if err >= 1.0 - 1.0 / k:
                going.discard(s)
                continue
            stumps.append((r["f"], r["cut"], r["low"], r["high"]))
            if err <= 0:
                alphas.append(1.0)
                going.discard(s)
                continue
            alphas.append(math.log((1 - err) / err) + math.log(k - 1))
        if not going:
            break
    return done


class _AdaParams(_ClassifierParams, HasSeed, HasWeightCol):
    numRounds = Param(Params._dummy(), "numRounds", "boosting rounds", typeConverter=TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", typeConverter=TypeConverters.toInt)
    stumps = Param(Params._dummy(), "stumps", "feature, cut, low class, high class per round",
                   typeConverter=TypeConverters.toListFloat)
    alphas = Param(Params._dummy(), "alphas", "stump weights", typeConverter=TypeConverters.toListFloat)


class AdaBoostClassifier(Estimator, _AdaParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", numRounds=50, seed=42):
        super().__init__()
        self._setDefault(numRounds=50)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AdaBoostModel:
        rows = forest_rows(df, self.getFeaturesCol(), self.getLabelCol())
        k = int(rows.agg(F.max("y")).first()[0]) + 1
        return self.fitted(*boost(rows, {-1: k}, self.getOrDefault(self.numRounds))[-1], k)

    def fitted(self, stumps: Sequence[Stump], alphas: Sequence[float], k: int) -> AdaBoostModel:
        return AdaBoostModel(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                             predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
                             numClasses=k, stumps=[float(v) for s in stumps for v in s], alphas=list(alphas))


class AdaBoostModel(Model, _AdaParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", numClasses=None, stumps=None, alphas=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.getOrDefault(self.numClasses)
        st, al = self.getOrDefault(self.stumps), self.getOrDefault(self.alphas)
        tmp = "__ada_x"
        # one array of (feature, cut, classes, weight): the plan stays small for any number of rounds
        table = F.array(*[F.struct(F.lit(int(st[4 * r])).alias("f"), F.lit(st[4 * r + 1]).alias("cut"),
                                   F.lit(int(st[4 * r + 2])).alias("low"), F.lit(int(st[4 * r + 3])).alias("high"),
                                   F.lit(a).alias("a")) for r, a in enumerate(al)]) if al else None
        d = df.withColumn(tmp, _features_array(df, self.getFeaturesCol()))
        if table is None:
            scores = [F.lit(1.0 / k)] * k
        else:
            def mass(c: int):
                return F.aggregate(table, F.lit(0.0), lambda acc, s: acc + F.when(
                    F.when(F.get(F.col(tmp), s["f"]) <= s["cut"], s["low"]).otherwise(s["high"]) == c, s["a"]).otherwise(0.0))
            scores = [mass(c) for c in range(k)]
        # SAMME decision scores; probabilities are shares of the total stump weight
        return _score_outputs(d, scores, self.getPredictionCol(), self.getProbabilityCol(), softmax=False).drop(tmp)
