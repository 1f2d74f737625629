"""Exact Shapley values of trees (path-dependent: absent features follow the training rows' shares).

A leaf is a box: per feature an interval, and the share ``z`` of training rows
that its splits on that feature keep. With ``o`` 1 where a row lies inside the
interval, else 0, the leaf's value ``v`` adds to feature ``i``

    v * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (t * o_j + (1 - t) * z_j),

the Shapley sum over all feature subsets written as an integral of a polynomial
of degree below the number of features on the path. Gauss-Legendre nodes
integrate it exactly, so all rows and leaves are worked off as arrays.

Tree parts are worked on in groups, as the forest was grown: the boxes of large
upper nodes lead every group to the root of its part. The explained rows (a
bounded number) go to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.forest import ForestModel, Packed, _matrix
from quarry.session import ship_package

#: Cells (leaves x features x nodes) worked on at once.
CELLS = 1 << 22


class Boxes:
    """Intervals and shares of some nodes, one row each."""

    def __init__(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, z: np.ndarray):
        self.at, self.lo, self.hi, self.z = at, lo, hi, z

    @classmethod
    def everything(cls, at: int, p: int) -> Boxes:
        return cls(np.array([at]), np.full((1, p), -np.inf), np.full((1, p), np.inf), np.ones((1, p)))

    def take(self, i: np.ndarray) -> Boxes:
        return Boxes(self.at[i], self.lo[i], self.hi[i], self.z[i])

    def inside(self, tree: Packed, side: int) -> Boxes:
        """The boxes of the children on one side (the children's cover still missing from the share)."""
        f, cut, rows = tree.f[self.at], tree.cut[self.at], np.arange(len(self.at))
        out = Boxes(self.at, self.lo.copy(), self.hi.copy(), self.z.copy())
        if side == 0:
            out.hi[rows, f] = np.minimum(out.hi[rows, f], cut)
        else:
            out.lo[rows, f] = np.maximum(out.lo[rows, f], cut)
        out.z[rows, f] /= tree.cover[self.at]
        return out


def descend(tree: Packed, start: Boxes):
    """Leaf boxes below ``start``, and ``(child key, box, split feature)`` of children that lie in other parts."""
    leaves, ends = [], []
    now = start
    while len(now.at):
        split = tree.f[now.at] >= 0
        leaves.append(now.take(np.flatnonzero(~split)))
        now = now.take(np.flatnonzero(split))
        below = []
        for side in (0, 1):
            box, child = now.inside(tree, side), tree.child[now.at, side]
            f = tree.f[now.at]
            for i in np.flatnonzero(child < 0).tolist():
                ends.append((int(tree.to[now.at[i], side]), box.take(np.array([i])), int(f[i])))
            here = np.flatnonzero(child >= 0)
            box = box.take(here)
            box.z[np.arange(len(here)), f[here]] *= tree.cover[child[here]]
            box.at = child[here]
            below.append(box)
        now = Boxes(*(np.concatenate([getattr(b, c) for b in below]) for c in ("at", "lo", "hi", "z")))
    every = Boxes(*(np.concatenate([getattr(b, c) for b in leaves]) for c in ("at", "lo", "hi", "z")))
    return every, ends


def contributions(x: np.ndarray, leaves: Boxes, value: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions ``(rows, features)`` of leaves with the given values, and their mean value."""
    n, p = x.shape
    used = (leaves.z < 1).sum(axis=1)
    nodes, weights = np.polynomial.legendre.leggauss(max(1, (int(used.max(initial=0)) + 1) // 2))
    t, w = (nodes + 1) / 2, weights / 2
    out = np.zeros((n, p))
    step = max(1, CELLS // (p * len(t)))
    for a in range(0, len(leaves.at), step):
        lo, hi, z, v = (c[a:a + step] for c in (leaves.lo, leaves.hi, leaves.z, value))
        for i in range(n):
            o = ((x[i] > lo) & (x[i] <= hi)).astype(float)
            factor = o[:, :, None] * t + z[:, :, None] * (1 - t)
            rest = factor.prod(axis=1, keepdims=True) / factor
            out[i] += ((o - z) * (rest * w).sum(axis=2) * v[:, None]).sum(axis=0)
    return out, float((leaves.z.prod(axis=1) * value).sum())


def tree_shap(model: ForestModel, df: DataFrame, key: str, names: list[str], class_index: int = 1) -> DataFrame:
    """``(key, feature, contribution, base)``: one row per explained row of ``df`` and feature slot.

    ``df`` holds the assembled features of a bounded number of rows (they are
    sent to every task). Contributions and base add up to the model's output
    (the class share of ``class_index``, or the mean). Missing features count
    as 0, as in scoring; an empty ``df`` gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    from quarry.operators.learners import _features_array

    classes, center = model.getOrDefault(model.numClasses), model.getOrDefault(model.center)
    p, trees = model.getOrDefault(model.numFeatures), model.getOrDefault(model.numTrees)
    x = F.transform(_features_array(df, model.getFeaturesCol()), lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
    rows = df.select(F.col(key).alias("key"), x.alias("x")).toArrow()
    points = _matrix(rows["x"]) if rows.num_rows else np.zeros((0, p))
    column = class_index if classes else 0
    nodes = model.nodes().select("t", "sub", "node", "depth", "f", "cut", "lo", "hi", "stats")
    tops = nodes.where("sub = 0").toArrow()
    out_schema = "row int, slot int, contribution double, base double"

    def batch(values: np.ndarray, base: float) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n, dtype=np.int32), p)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)),
             pa.array(values.reshape(-1) / trees), pa.array(np.full(n * p, base / trees))],
            names=["row", "slot", "contribution", "base"])

    def part(table: pa.Table) -> pa.Table:
        t, sub = table["t"][0].as_py(), table["sub"][0].as_py()
        tree = Packed(table, classes, center)
        root = int(tree.start[0])
        start = Boxes.everything(root, p)
        if sub and tops.num_rows:
            mine = tops.filter(pa.array(tops["t"].to_numpy() == t))
            if mine.num_rows:
                top = Packed(mine, classes, center)
                _, ends = descend(top, Boxes.everything(int(top.start[0]), p))
                box, f = next((b, f) for k, b, f in ends if k == sub)
                box.z[0, f] *= tree.cover[root]
                start = Boxes(np.array([root]), box.lo, box.hi, box.z)
        leaves, _ = descend(tree, start)
        return pa.Table.from_batches([batch(*contributions(points, leaves, tree.value[leaves.at, column]))])

    per = nodes.groupBy("t", "sub").applyInArrow(part, out_schema)
    total = per.groupBy("row", "slot").agg(F.sum("contribution").alias("contribution"), F.sum("base").alias("base"))
    labels = spark.createDataFrame([(i, names[i] if i < len(names) else f"f{i}") for i in range(p)], "slot int, feature string")
    keys = spark.createDataFrame(pa.table({"row": pa.array(np.arange(rows.num_rows, dtype=np.int32)), key: rows["key"]}))
    return total.join(F.broadcast(labels), "slot").join(F.broadcast(keys), "row").select(
        key, "feature", "contribution", "base")
