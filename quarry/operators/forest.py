"""Forests and single trees without a depth limit, as Spark jobs.

Three kinds of tree: ``extra`` (every row, one random cut per candidate
feature; Geurts, Ernst & Wehenkel, 2006), ``forest`` (bootstrap rows, best cut;
Breiman, 2001) and ``tree`` (every row, all features). Everything random is a
hash of (seed, tree, path to the node, feature) or of (seed, tree, row), so a
tree does not depend on where its nodes are worked on:

* Rows are stored once. A level of the large nodes of all trees of all settings
  is one map-side range of every feature, one map-side count of the drawn
  candidates by ranges of their values (``BUCKETS``), and one of the single values
  in those ranges that, by a bound on their cuts, may still hold the best; a row's
  node is found anew by walking the splits known so far (at most ``MAX_OPEN`` large
  nodes a wave), so no level writes the rows again.
* A node of at most ``handoff`` rows is finished whole, to any depth, in one
  grouped task, which also scores the held rows of a cross validation. A table that small (and at most ``BROADCAST_BYTES`` long) is
  handed to the tasks at once, one tree a piece, without a shuffle.

Several settings and folds (``Grower``) grow together in the same jobs. Splits
are chosen among all values of a feature, however many rows there are.

The result is a node table; the fitted model keeps it inside its own folder
when it is saved, so a saved run can be moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.learners import _features_array
from quarry.session import checkpoint_root, scratch_dir, ship_package

#: Rows of a node that one task finishes.
HANDOFF = 1_000_000
#: Bytes of rows, or of a packed forest, that may be sent to every task.
BROADCAST_BYTES = 192 << 20
#: Rows of the trees that grow side by side in one task.
TOGETHER_ROWS = 60_000
#: Ranges of values in which the cuts of a large node are first looked at.
BUCKETS = 1_024
#: Large nodes worked on (and known to the driver) at once; more trees wait for the next wave.
MAX_OPEN = 50_000
#: Tasks that finish the smaller nodes of one wave, at most.
FINISH_PARTS = 2_000
#: Bytes of rows that the trees of one wave may hand to the tasks that finish them.
WAVE_BYTES = 8 << 30
#: Rows that a task looks at together.
BLOCK_ROWS = 20_000

NODES = ("job int, t int, sub long, node long, depth int, f int, cut double, lo long, hi long, gain double, "
         "stats array<double>")

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for seeded draws."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _draw(*parts) -> np.ndarray:
    """A 64-bit hash of numbers (arrays broadcast)."""
    out = np.zeros(1, _U)
    for p in parts:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + np.asarray(p, np.int64).view(_U) + _U(1))
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(float) * 2.0 ** -53


@dataclass(frozen=True)
class Grower:
    """One forest to grow: settings, and the ``store`` whose rows (but the held ones) it learns from."""
    kind: str
    classes: int  # 0: regression
    trees: int = 100
    max_depth: int = 0  # 0: none
    min_rows: int = 1
    features: int = 1  # candidates per node
    seed: int = 42
    store: int = -1
    center: float = 0.0  # subtracted from regression targets (keeps sums of squares exact)
    scale: float = 2.0 ** 16  # regression splits compare targets in whole steps of 1 / scale, whose sums are exact in any order

    def root(self, tree: int) -> int:
        return int(_draw(self.seed, tree).view(np.int64)[0]) or 1

    def bag(self, tree: int, rid: np.ndarray) -> np.ndarray:
        """How often each row is drawn: once, or Poisson(1) for bootstrap forests."""
        if self.kind != "forest":
            return np.ones(len(rid))
        steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
        return np.searchsorted(steps, _unit(_draw(self.seed, tree, rid, 7)), "right").astype(float)

    def stats(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Additive statistics per row: class weights, or weight and weighted first and second moment; last the row count."""
        if self.classes:
            out = np.zeros((len(y), self.classes + 1))
            out[np.arange(len(y)), y.astype(int)] = w
        else:
            z = y - self.center
            out = np.column_stack([w, w * z, w * z * z, w])
        out[:, -1] = 1.0
        return out

    def steps(self, y: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        """Weights and weighted targets in whole steps, for sums that are exact; None: weights are not whole numbers."""
        whole = np.rint(w)
        if self.classes or not (whole == w).all():
            return None
        return np.column_stack([whole, np.rint((y - self.center) * self.scale) * whole]).astype(np.int64)

    def exact(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Additive sums by which cuts are compared: ``stats`` of classes, or weight, weighted target in steps and row count."""
        if self.classes:
            return self.stats(y, w)
        steps = self.steps(y, w)
        if steps is None:
            steps = np.column_stack([w, (y - self.center) * self.scale * w])
        return np.column_stack([steps, np.ones(len(y), steps.dtype)])

    def rated(self, left: np.ndarray, whole: np.ndarray, total: np.ndarray) -> np.ndarray:
        """``relative`` from sums of shape ``exact``: of the left sides, and of the node (whose statistics are ``total``)."""
        if self.classes:
            return self.relative(left, whole)
        mean, rest = np.divmod(whole[1], whole[0])
        low, mass = left[:, 0].astype(float), float(whole[0])
        off = (left[:, 1] - left[:, 0] * mean) - low * (rest / whole[0])
        ok = (left[:, 2] >= self.min_rows) & (whole[2] - left[:, 2] >= self.min_rows) & (low > 0) & (low < mass)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.round(1 - off * off * (mass / (low * (mass - low))) / (self.loss(total) * self.scale ** 2), 12)
        return np.where(ok, share, np.inf)

    def floor(self, start: np.ndarray, inside: np.ndarray, whole: np.ndarray, total: np.ndarray, least: np.ndarray,
              most: np.ndarray) -> np.ndarray:
        """Below the relative loss of every cut that adds a part of ``inside`` to the left side ``start``.

        What a split saves is convex in the sums of its left side, so its most lies in a corner of what they can be:
        any part of each class, or ``least`` to ``most`` (steps of the target) per unit of weight.
        """
        k = self.classes
        if k > 6:
            return np.full(len(start), -np.inf)

        def ratio(a, b):
            return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)
        if k:
            best = np.zeros(len(start))
            for corner in range(1 << k):
                c = start[:, :-1] + inside[:, :-1] * [corner >> i & 1 for i in range(k)]
                r = whole[:-1] - c
                best = np.maximum(best, ratio((c * c).sum(axis=1), c.sum(axis=1)) + ratio((r * r).sum(axis=1), r.sum(axis=1)))
            return (whole[:-1].sum() - best) / self.loss(total) - 1e-9
        mean = whole[1] / whole[0]
        mass, n, m = float(whole[0]), start[:, 0].astype(float), inside[:, 0].astype(float)
        off, d = start[:, 1] - n * mean, inside[:, 1] - m * mean
        lo, hi = least - mean, most - mean
        span = np.maximum(hi - lo, 1e-300)
        a, b = np.clip((m * hi - d) / span, 0, m), np.clip((d - m * lo) / span, 0, m)
        best = np.zeros(len(start))
        for add, more in ((0.0, 0.0), (m, d), (a, a * lo), (b, b * hi)):
            low = n + add
            best = np.maximum(best, ratio((off + more) ** 2 * mass, low * (mass - low)))
        return 1 - best / (self.loss(total) * self.scale ** 2) - 1e-9

    def loss(self, s: np.ndarray) -> np.ndarray:
        """Weighted Gini impurity or squared error of summed statistics."""
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.classes:
                c = s[..., :-1]
                total = c.sum(-1)
                out = total - (c * c).sum(-1) / total
            else:
                out = s[..., 2] - s[..., 1] ** 2 / s[..., 0]
        return np.maximum(np.nan_to_num(out), 0.0)

    def splittable(self, total: np.ndarray, depth: int) -> np.ndarray:
        scale = total[..., :-1].sum(-1) if self.classes else total[..., 2]
        return ((self.loss(total) > 1e-12 * np.maximum(scale, 1e-300)) & (total[..., -1] >= 2 * self.min_rows)
                & (not self.max_depth or depth < self.max_depth))

    def children(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.where((k := _draw(keys, side).view(np.int64)) == 0, 1, k) for side in (1, 2))

    def candidates(self, keys: np.ndarray, varies: np.ndarray) -> np.ndarray:
        """Per node the features to try: those of smallest hash among the ones that vary."""
        h = _draw(keys[:, None], np.arange(varies.shape[1])[None, :], 3)
        h = np.where(varies, h, _U(2**64 - 1))
        return np.argsort(h, axis=1, kind="stable")[:, :self.features]

    def random_cut(self, keys: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        cut = lo + _unit(_draw(keys, f, 5)) * (hi - lo)
        return np.where(cut >= hi, lo, cut)

    def relative(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Loss after a split over loss before, rounded so that the order of sums does not matter."""
        right = total - left
        ok = (left[..., -1] >= self.min_rows) & (right[..., -1] >= self.min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (self.loss(left) + self.loss(right)) / self.loss(total)
        return np.where(ok, np.round(share, 12), np.inf)


def target_steps(least: float, mean: float, most: float) -> tuple[float, float]:
    """``center`` and ``scale`` of regression targets: the mean, and 2 ** 35 steps at most from it to the farthest target."""
    return mean, 2.0 ** (35 - math.frexp(max(most - mean, mean - least, 1e-290))[1])


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = a + (b - a) / 2
    return np.where(m >= b, a, m)


def _sums(stats: np.ndarray, rows: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """Statistics of ``rows`` summed per node."""
    return np.column_stack([np.bincount(node, stats[rows, c], n) for c in range(stats.shape[1])])


def _random_splits(g: Grower, x: np.ndarray, stats: np.ndarray, rows: np.ndarray, node: np.ndarray, pick: np.ndarray,
                   varies: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray, total: np.ndarray):
    """Feature, cut and relative loss per node (infinite: no split) among one random cut per candidate."""
    at = np.arange(len(keys))
    best_f, best_cut, best = np.full(len(keys), -1), np.zeros(len(keys)), np.full(len(keys), np.inf)
    for j in range(pick.shape[1]):
        f = pick[:, j]
        cut = g.random_cut(keys, f, lo[at, f], hi[at, f])
        low = np.flatnonzero(x[rows, f[node]] <= cut[node])
        share = np.where(varies[at, f], g.relative(_sums(stats, rows[low], node[low], len(keys)), total), np.inf)
        better = share < best
        best_f, best_cut, best = np.where(better, f, best_f), np.where(better, cut, best_cut), np.where(better, share, best)
    return best_f, best_cut, best


def _random_splits_of_all(g: Grower, columns: Sequence[np.ndarray], stats: Sequence[np.ndarray], node: np.ndarray,
                          counts: np.ndarray, keys: np.ndarray, total: np.ndarray):
    """What ``_random_splits`` finds, feature by feature, where most features are candidates; columns lie by ``node``."""
    m, p = len(keys), len(columns)
    starts = np.cumsum(counts) - counts
    lo, hi = (np.stack([u.reduceat(c, starts) for c in columns]) for u in (np.minimum, np.maximum))
    varies = (hi > lo).T
    pick = g.candidates(keys, varies)
    drawn = np.full((m, p), p)  # a node's candidates in the order they were drawn
    np.put_along_axis(drawn, pick, np.broadcast_to(np.arange(pick.shape[1]), pick.shape).copy(), axis=1)
    drawn[~varies] = p
    best_f, best_cut, best, best_rank = np.full(m, -1), np.zeros(m), np.full(m, np.inf), np.full(m, p)
    plain = not g.classes and bool((stats[0] == 1).all())
    for f in range(p):
        at = np.flatnonzero(drawn[:, f] < p)
        if not len(at):
            continue
        cut = np.full(m, -np.inf)
        cut[at] = g.random_cut(keys[at], np.full(len(at), f), lo[f, at], hi[f, at])
        low = columns[f] <= np.repeat(cut, counts)
        if plain:  # the weights are ones
            n_low = np.add.reduceat(low.view(np.uint8), starts, dtype=np.int64).astype(float)
            left = np.column_stack([n_low, *(np.bincount(node, c * low, m) for c in stats[1:3]), n_low])
        else:
            left = np.column_stack([np.bincount(node, c * low, m) for c in stats])
        share = np.full(m, np.inf)
        share[at] = g.relative(left[at], total[at])
        rank = drawn[:, f]
        better = (share < best) | ((share == best) & np.isfinite(share) & (rank < best_rank))
        best_f, best_cut, best = np.where(better, f, best_f), np.where(better, cut, best_cut), np.where(better, share, best)
        best_rank = np.where(better, rank, best_rank)
    return best_f, best_cut, best


def _best_splits(g: Grower, values: np.ndarray, offset: np.ndarray, codes: np.ndarray, stats: np.ndarray, rows: np.ndarray,
                 node: np.ndarray, pick: np.ndarray, varies: np.ndarray, total: np.ndarray):
    """Feature, cut and relative loss per node among all cuts of its candidates: ties go to the candidate drawn first.

    ``codes`` are the ranks of a feature's values, listed in ``values`` from ``offset`` on. The rows are sorted by node and
    value once per candidate drawn, or once per feature where these are fewer or sums are not exact (not whole numbers):
    then the order of the sums depends on the rows alone.
    """
    m, p = varies.shape
    best_f, best_cut, best, best_rank = np.full(m, -1), np.zeros(m), np.full(m, np.inf), np.full(m, p)
    span, flat, nodes = np.int64(codes.max(initial=0)) + 1, codes.reshape(-1), np.arange(m)
    exact = bool((stats == np.rint(stats)).all() and np.abs(stats).sum(axis=0).max(initial=0) < 2 ** 53)
    drawn = np.full((m, p), p)  # a node's candidates in the order they were drawn
    np.put_along_axis(drawn, pick, np.broadcast_to(np.arange(pick.shape[1]), pick.shape).copy(), axis=1)
    drawn[~varies] = p
    for j in range(pick.shape[1] if exact else p):
        f = pick[:, j] if exact else np.full(m, j)
        rank = drawn[nodes, f]
        able = rank < p
        r, nd = rows, node
        if not able.all():
            ok = able[node]
            r, nd = rows[ok], node[ok]
        if not len(r):
            continue
        key = nd * span + flat.take(r * p + f.take(nd))
        order = np.argsort(key, kind=None if exact else "stable")
        r, key = r.take(order), key.take(order)
        steps = np.flatnonzero(key[1:] > key[:-1])  # last row of a value
        left = np.cumsum(stats.take(r, axis=0), axis=0)
        at = nd[steps]  # rows come by node, so the order of sorting keeps a place's node
        inside = at == nd[steps + 1]
        ends, at, last = steps[inside], at[inside], steps[~inside]
        base = np.zeros((m, left.shape[1]))
        base[nd[last + 1]] = left[last]
        share = g.relative(left[ends] - base[at], total[at])
        low = np.full(m, np.inf)
        np.minimum.at(low, at, share)
        hits = np.flatnonzero(share == low[at])
        which, spot = np.unique(at[hits], return_index=True)
        spot = ends[hits[spot]]
        cut, start = np.zeros(m), which * span - offset[f[which]]
        cut[which] = _middle(values[key[spot] - start], values[key[spot + 1] - start])
        better = (low < best) | ((low == best) & np.isfinite(low) & (rank < best_rank))
        best_f, best_cut, best = np.where(better, f, best_f), np.where(better, cut, best_cut), np.where(better, low, best)
        best_rank = np.where(better, rank, best_rank)
    return best_f, best_cut, best


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of all features in a row, where each feature's begin, and the table as ranks of its values."""
    distinct, ranks = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])))
    offset = np.cumsum([0, *map(len, distinct)])[:-1]
    small = max(map(len, distinct)) <= 1 << 16
    return np.concatenate(distinct), offset, np.column_stack(ranks).astype(np.uint16 if small else np.int32)


class _Sorted:
    """Best cuts of regression trees among all values: rows are sorted once per feature and then dealt to the children.

    Each feature keeps its rows in the order of node, value and row; a feature of two values only the rows of the higher
    one. Targets are whole steps less their node's whole mean, so running sums over all nodes stay exact.
    """

    def __init__(self, g: Grower, known: np.ndarray, offset: np.ndarray, codes: np.ndarray, steps: np.ndarray, node: np.ndarray):
        self.g, self.known, self.offset = g, known, offset
        self.weight, self.target = np.ascontiguousarray(steps[:, 0]), np.ascontiguousarray(steps[:, 1])
        self.single = bool((self.weight == 1).all())
        self.side, self.node, self.centred = np.empty(len(codes), np.uint8), np.empty(len(codes), np.int32), np.empty(len(codes), np.int64)
        self.code, self.order, self.two = [], [], []
        for c in (np.ascontiguousarray(c) for c in codes.T):
            two = int(c.max(initial=0)) <= 1
            order = np.flatnonzero(c) if two else np.lexsort((c, node))
            self.code.append(c)
            self.two.append(two)
            self.order.append(order)

    def deal(self, rows: np.ndarray, side: np.ndarray) -> None:
        """Give ``rows`` to the lower (0) or the higher children (1), or to none (2): first all lower, then all higher ones."""
        self.side[rows] = side
        for j, order in enumerate(self.order):
            s = self.side.take(order)
            self.order[j] = np.concatenate([order[s == 0], order[s == 1]])

    def best(self, rows: np.ndarray, counts: np.ndarray, keys: np.ndarray, total: np.ndarray, able: np.ndarray):
        """Feature, cut and relative loss per node (infinite: no split); ties go to the candidate drawn first."""
        m, p, n = len(counts), len(self.order), len(rows)
        ends = np.cumsum(counts)
        starts = ends - counts
        node = np.repeat(np.arange(m, dtype=np.int32), counts)
        self.node[rows] = node
        target = self.target.take(rows)
        weight = None if self.single else self.weight.take(rows)
        mass = counts if self.single else np.add.reduceat(weight, starts)
        mean, rest = np.divmod(np.add.reduceat(target, starts), mass)
        part = rest / mass
        target -= np.repeat(mean, counts) if self.single else np.repeat(mean, counts) * weight
        self.centred[rows] = target
        before = np.cumsum(rest) - rest  # what the running sum holds where a node begins
        whole = mass.astype(float)
        short = np.empty(0, np.int64)
        if self.g.min_rows > 1:
            place = np.arange(1, n + 1) - np.repeat(starts, counts)
            short = np.flatnonzero((place < self.g.min_rows) | (np.repeat(counts, counts) - place < self.g.min_rows))
        last = ends - 1
        if self.single:
            low = (np.arange(1, n + 1) - np.repeat(starts, counts)).astype(float)
            high = np.repeat(whole, counts) - low
            high[last] = 1.0
            factor = np.repeat(whole, counts) / (low * high)
            shift = np.repeat(before.astype(float), counts) + low * np.repeat(part, counts)
        else:
            begun = np.repeat(np.cumsum(mass) - mass, counts)
            mass_of, before_of, part_of = np.repeat(whole, counts), np.repeat(before.astype(float), counts), np.repeat(part, counts)
        gains: list[np.ndarray] = [np.empty(0)] * p
        top = np.full((p, m), -1.0)  # best gain per feature and node
        varies = np.zeros((p, m), bool)
        for f in range(p):
            order = self.order[f]
            if self.two[f]:
                at = self.node.take(order)
                n_high = np.bincount(at, minlength=m)
                w_high = n_high if self.single else np.bincount(at, self.weight.take(order), m)
                s_high = np.bincount(at, self.centred.take(order), m)
                varies[f] = (n_high > 0) & (n_high < counts)
                off = s_high - w_high * part
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = off * off * (whole / (w_high * (whole - w_high)))
                ok = varies[f] & (n_high >= self.g.min_rows) & (counts - n_high >= self.g.min_rows)
                top[f] = np.where(ok, gain, -1.0)
                continue
            code = self.code[f].take(order)
            same = code[1:] == code[:-1]
            varies[f] = code[starts] != code[last]
            gain = np.cumsum(self.centred.take(order)).astype(float)
            if self.single:
                gain -= shift
                gain *= gain
                gain *= factor
            else:
                low = (np.cumsum(self.weight.take(order)) - begun).astype(float)
                gain -= before_of
                gain -= low * part_of
                gain *= gain
                high = mass_of - low
                high[last] = 1.0
                low *= high
                gain /= low
                gain *= mass_of
            gain[:-1][same] = -1.0
            gain[last] = -1.0
            gain[short] = -1.0
            gains[f] = gain
            top[f] = np.maximum.reduceat(gain, starts)
        loss = np.where(able, self.g.loss(total) * self.g.scale ** 2, 1.0)
        drawn = np.zeros((m, p), bool)
        if self.g.features >= p:
            drawn[:] = varies.T
        else:
            np.put_along_axis(drawn, self.g.candidates(keys, varies.T), True, axis=1)
            drawn &= varies.T
        rated = np.where(drawn & (top.T >= 0) & able[:, None], np.round(1 - top.T / loss[:, None], 12), np.inf)
        share = rated.min(axis=1)
        h = _draw(keys[:, None], np.arange(p)[None, :], 3)
        win = np.where((rated == share[:, None]) & np.isfinite(rated), h, _U(2**64 - 1)).argmin(axis=1)
        win = np.where(np.isfinite(share), win, -1)
        cut = np.zeros(m)
        win_of = np.repeat(win.astype(np.int16), counts)
        near = top[np.maximum(win, 0), np.arange(m)] - 2e-12 * loss
        for f in range(p):
            which = np.flatnonzero(win == f)
            if not len(which):
                continue
            values, order = self.known[self.offset[f]:], self.order[f]
            if self.two[f]:
                cut[which] = _middle(values[0], values[1])
                continue
            at = np.flatnonzero(win_of == f)
            here = node.take(at)
            gain = gains[f].take(at)
            ok = gain >= near.take(here)
            at, here = at[ok], here[ok]
            ok = np.round(1 - gain[ok] / loss.take(here), 12) == share.take(here)
            at, here = at[ok], here[ok]
            at = at[np.append(True, here[1:] != here[:-1])]  # the lowest cut
            cut[which] = _middle(values[self.code[f].take(order.take(at))], values[self.code[f].take(order.take(at + 1))])
        return win, cut, share


def grow(g: Grower, job: int, trees: Sequence[int], keys: Sequence[int], x: np.ndarray, stats: np.ndarray,
         root: np.ndarray, depth: int, steps: np.ndarray | None = None) -> pa.RecordBatch:
    """The whole subtrees below the nodes ``keys`` (one per tree), level by level over all their nodes at once.

    Rows lie side by side by ``root``, the place of their node in ``keys``. ``steps`` are those of ``Grower.steps``.
    """
    rows, roots, keys, trees = np.arange(len(x)), np.array(keys, np.int64), np.array(keys, np.int64), np.array(trees)
    counts = np.bincount(root, minlength=len(keys))  # rows lie by node
    of = np.arange(len(keys))  # the subtree of every node
    columns, sums = [np.ascontiguousarray(c) for c in x.T], [np.ascontiguousarray(c) for c in stats.T]
    broad = g.kind == "extra" and 2 * g.features >= x.shape[1]  # the columns are kept in the order of ``rows``
    if not broad:
        known, offset, codes = _ranked(x)
    by_value = _Sorted(g, known, offset, codes, steps, root) if g.kind != "extra" and steps is not None else None
    out: list[tuple] = []
    while len(keys):
        node = np.repeat(np.arange(len(keys)), counts)
        total = np.column_stack([np.bincount(node, c, len(keys)) for c in sums])  # ``sums`` lie as ``rows``
        f, cut, share = np.full(len(keys), -1), np.zeros(len(keys)), np.full(len(keys), np.inf)
        able = g.splittable(total, depth)
        todo = np.flatnonzero(able)
        if len(todo) and by_value is not None:
            f, cut, share = by_value.best(rows, counts, keys, total, able)
        elif len(todo) and broad:
            f, cut, share = _random_splits_of_all(g, columns, sums, node, counts, keys, total)
            share = np.where(able, share, np.inf)
        elif len(todo):
            place = np.full(len(keys), -1)
            place[todo] = np.arange(len(todo))
            live = np.repeat(able, counts)
            r, nd = rows[live], place[node[live]]
            starts = np.cumsum(counts[todo]) - counts[todo]
            values = codes.take(r, axis=0)
            lo, hi = np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(values, starts, axis=0)
            varies = hi > lo
            pick = g.candidates(keys[todo], varies)
            if g.kind == "extra":
                found = _random_splits(g, x, stats, r, nd, pick, varies, known[offset + lo], known[offset + hi], keys[todo], total[todo])
            else:
                found = _best_splits(g, known, offset, codes, stats, r, nd, pick, varies, total[todo])
            f[todo], cut[todo], share[todo] = found
        split = np.isfinite(share)
        left, right = g.children(keys)
        gain = np.where(split, g.loss(total) * (1 - np.where(split, share, 1.0)), 0.0)
        out.append((trees[of], roots[of], keys, np.full(len(keys), depth), np.where(split, f, -1), cut, np.where(split, left, 0),
                    np.where(split, right, 0), gain, total))
        side = np.full(len(rows), 2, np.uint8)
        f_of = np.repeat(np.where(split, f, -1).astype(np.int32), counts)
        for j in np.unique(f[split]):
            at = np.flatnonzero(f_of == j)
            side[at] = columns[j].take(at if broad else rows.take(at)) > cut.take(node.take(at))
        if by_value is not None:
            by_value.deal(rows, side)
        low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        on = np.concatenate([low, high])
        counts = np.concatenate([np.bincount(node.take(part), minlength=len(keys))[split] for part in (low, high)])
        rows, sums = rows.take(on), [c.take(on) for c in sums]
        if broad:
            columns = [c.take(on) for c in columns]
        keys = np.concatenate([left[split], right[split]])
        of = np.concatenate([of[split], of[split]])
        depth += 1
    return _node_batch(job, [np.concatenate(c) for c in zip(*out)])


def _node_batch(job: int, columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    t, sub, key, depth, f, cut, lo, hi, gain, total = columns
    n = len(key)
    stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * total.shape[1]),
                                     pa.array(total.reshape(-1).astype(float)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, job, np.int32)), pa.array(t.astype(np.int32)), pa.array(sub.astype(np.int64)),
         pa.array(key), pa.array(depth.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(cut.astype(float)),
         pa.array(lo), pa.array(hi), pa.array(gain.astype(float)), stats],
        names=["job", "t", "sub", "node", "depth", "f", "cut", "lo", "hi", "gain", "stats"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


ROWS = "rid long, store int, held boolean, x array<double>, y double, w double"


def forest_rows(df: DataFrame, features: str, label: str, weight: str | None = None) -> DataFrame:
    """Training rows as stored columns (``ROWS``); missing feature values count as 0."""
    x = F.transform(_features_array(df, features), lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
    out = df.select(F.monotonically_increasing_id().alias("rid"), F.lit(-1).alias("store"), F.lit(False).alias("held"),
                    x.alias("x"), F.col(label).cast("double").alias("y"),
                    (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).where("y is not null")
    return stored_rows(out)


def stored_rows(rows: DataFrame) -> DataFrame:
    """Store rows of shape ``ROWS`` as they are."""
    checkpoint_root(rows.sparkSession)
    return rows.select("rid", "store", "held", "x", "y", "w").checkpoint(eager=True)


def grow_forests(rows: DataFrame, growers: Sequence[Grower], handoff: int = HANDOFF) -> DataFrame:
    """Node tables (``NODES``) of all growers, ``job`` being a grower's place in the list.

    ``rows`` is a stored table of shape ``ROWS``. An empty store gives no nodes.
    """
    return _grown(rows, growers, handoff).checkpoint(eager=True)


def _grown(rows: DataFrame, growers: Sequence[Grower], handoff: int) -> DataFrame:
    """``grow_forests``, whose nodes below ``handoff`` rows grow when they are first read."""
    if _fits(rows, handoff):
        return _SharedWork(rows, growers).run(lambda job, nodes, held: nodes, NODES)
    parts, ranges = rows.sparkSession.createDataFrame([], NODES), _ranges(rows, handoff)
    for work in _waves(growers, handoff, ranges):
        parts = parts.unionByName(_Levels(rows, growers, work, handoff, ranges).nodes())
    return parts


def _fits(rows: DataFrame, handoff: int) -> bool:
    """Whether the table is one node for a task, and small enough to be sent to all."""
    ship_package(rows.sparkSession)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    return size["n"] <= handoff and size["n"] * ((size["p"] or 0) + 5) * 8 <= BROADCAST_BYTES


@dataclass(frozen=True)
class _Ranges:
    """Of a stored table: learning rows and their bytes per store, ends of ``BUCKETS`` ranges per feature, whole weights?"""
    sizes: dict[int, int]
    bytes: dict[int, int]
    edges: list[np.ndarray]
    whole: bool


def _ranges(rows: DataFrame, handoff: int) -> _Ranges:
    learn = rows.where("not held")
    seen = learn.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"),
                                      F.max(F.col("w") != F.rint("w")).alias("parts")).collect()
    sizes, p = {r["store"]: r["n"] for r in seen}, max((r["p"] or 0 for r in seen), default=0)
    edges = []
    if max(sizes.values(), default=0) > handoff:
        # where the ends lie changes the work, not the trees
        shares = [i / BUCKETS for i in range(1, BUCKETS)]
        found = learn.agg(*[F.percentile_approx(F.col("x")[j], shares, 4 * BUCKETS).alias(f"e{j}") for j in range(p)]).first()
        edges = [np.unique(np.array(e, float)) for e in found]
    return _Ranges(sizes, {r["store"]: r["n"] * ((r["p"] or 0) + 4) * 8 for r in seen}, edges, not any(r["parts"] for r in seen))


class _SharedWork:
    """A small table sent to all tasks; a task grows some trees of one setting side by side."""

    def __init__(self, rows: DataFrame, growers: Sequence[Grower], jobs: Sequence[int] | None = None):
        self.spark, self.growers = rows.sparkSession, list(growers)
        todo = [(job, growers[job].trees) for job in (range(len(growers)) if jobs is None else jobs)]
        table = rows.orderBy("store", "rid").toArrow()
        self.shared = self.spark.sparkContext.broadcast(
            (table["rid"].to_numpy(), table["store"].to_numpy(), table["held"].to_numpy(), _matrix(table["x"]),
             table["y"].to_numpy(), table["w"].to_numpy()))
        self.parallel = max(self.spark.sparkContext.defaultParallelism, 1)
        # trees of one setting grow side by side: enough of them to be worth a step, few enough to spread the work
        side = max(1, min(TOGETHER_ROWS // max(table.num_rows, 1), math.ceil(sum(n for _, n in todo) / (2 * self.parallel))))
        self.work = [(job, range(t, min(t + side, n))) for job, n in todo for t in range(0, n, side)]

    def run(self, emit, schema: str) -> DataFrame:
        """What ``emit(job, nodes, (rid, x, y) of the held rows)`` makes of every piece of work."""
        shared, work, growers = self.shared, self.work, self.growers

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rid, store, held, x, y, weight = shared.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    job, trees = work[i]
                    g = growers[job]
                    here = store == g.store
                    mine, away = np.flatnonzero(here & ~held), np.flatnonzero(here & held)
                    if not len(mine):
                        continue
                    drawn = [(t, bag) for t in trees if (bag := g.bag(t, rid[mine])).any()]
                    at = np.concatenate([mine[bag > 0] for _, bag in drawn])
                    w = weight[at] * np.concatenate([bag[bag > 0] for _, bag in drawn])
                    root = np.repeat(np.arange(len(drawn)), [int((bag > 0).sum()) for _, bag in drawn])
                    ts = [t for t, _ in drawn]
                    nodes = grow(g, job, ts, [g.root(t) for t in ts], x[at], g.stats(y[at], w), root, 0, g.steps(y[at], w))
                    yield emit(job, nodes, (rid[away], x[away], y[away]))

        order = self.spark.range(0, len(work), 1, max(min(len(work), 4 * self.parallel), 1))
        return order.mapInArrow(each, schema)


def cross_values(rows: DataFrame, growers: Sequence[Grower], handoff: int = HANDOFF) -> DataFrame:
    """``(job, rid, y, value)`` of every grower's held rows, as ``held_out_values`` of what ``grow_forests`` grows.

    Trees score their held rows where they grow and are not kept.
    """
    info = [(g.classes, g.center) for g in growers]
    width = max((g.classes or 1) for g in growers)
    names = [f"v{i}" for i in range(width)]
    schema = "job int, rid long, y double, trees long, " + ", ".join(f"{n} double" for n in names)

    def emit(job: int, nodes: pa.RecordBatch, held) -> pa.RecordBatch:
        rid, x, y = held
        packed = Packed(pa.Table.from_batches([nodes]), *info[job])
        total = np.zeros((len(rid), width))
        value = packed.predict(x) * len(packed.start)
        total[:, :value.shape[1]] = value
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rid), job, np.int32)), pa.array(rid), pa.array(y),
             pa.array(np.full(len(rid), len(packed.start), np.int64)), *[pa.array(total[:, i]) for i in range(width)]],
            names=["job", "rid", "y", "trees", *names])

    if _fits(rows, handoff):
        return _means(_SharedWork(rows, growers).run(emit, schema), names)
    parts, rest = rows.sparkSession.createDataFrame([], schema), []
    for store in dict.fromkeys(g.store for g in growers):
        mine = rows.where(F.col("store") == store)
        if _fits(mine, handoff):  # one fold after the other is sent to all tasks
            each = _SharedWork(mine, growers, [job for job, g in enumerate(growers) if g.store == store]).run(emit, schema)
            parts = parts.unionByName(each.groupBy("job", "rid").agg(
                F.first("y").alias("y"), F.sum("trees").alias("trees"), *[F.sum(n).alias(n) for n in names]).checkpoint(eager=True))
        else:
            rest.append(store)
    if rest:
        ranges = _ranges(rows.where(F.col("store").isin(rest)), handoff)
        for work in _waves(growers, handoff, ranges):
            parts = parts.unionByName(_Levels(rows, growers, work, handoff, ranges).held_values(width).checkpoint(eager=True))
    return _means(parts, names)


def _means(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    return sums.groupBy("job", "rid").agg(F.first("y").alias("y"), F.sum("trees").alias("trees"),
                                          *[F.sum(n).alias(n) for n in names]).select(
        "job", "rid", "y", F.array(*[F.col(n) / F.col("trees") for n in names]).alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in blocks of a few Arrow batches."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept += [b] if b.num_rows else []
        if sum(k.num_rows for k in kept) >= BLOCK_ROWS:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _waves(growers: Sequence[Grower], handoff: int, ranges: _Ranges) -> Iterator[list[tuple[int, int]]]:
    """Pieces of work (grower, tree) that go through the levels together: of like targets, few large nodes and bounded bytes."""
    for classes in dict.fromkeys(g.classes for g in growers):
        wave, nodes, size = [], 0, 0
        for job, g in enumerate(growers):
            if g.classes != classes or g.store not in ranges.sizes:
                continue
            n, b = ranges.sizes[g.store], ranges.bytes[g.store]
            for t in range(g.trees):
                if wave and (nodes + 2 * n // handoff + 1 > MAX_OPEN or size + b > WAVE_BYTES):
                    yield wave
                    wave, nodes, size = [], 0, 0
                wave.append((job, t))
                nodes, size = nodes + 2 * n // handoff + 1, size + b
        if wave:
            yield wave


class _Levels:
    """The trees of one wave: nodes of more than ``handoff`` rows are split level by level, the others in grouped tasks.

    Trees that differ only in their limits (settings of a search) have the same
    upper nodes as long as they choose the same splits; such a node is counted once.
    """

    def __init__(self, rows: DataFrame, growers: Sequence[Grower], work: Sequence[tuple[int, int]], handoff: int, ranges: _Ranges):
        self.rows, self.growers, self.work, self.handoff, self.ranges = rows, list(growers), list(work), handoff, ranges
        self.moves: dict = {(job, t): {} for job, t in work}  # per tree: node -> feature, cut, children
        self.leaves: dict = {}
        self.depths: dict = {}  # nodes left to the grouped tasks
        self.top: list[pa.RecordBatch] = []
        g = growers[work[0][0]]
        self.stats = [f"t{i}" for i in range(g.classes + 1 if g.classes else 4)]
        kind = "long" if ranges.whole and not g.classes else "double"
        self.sums = {f"s{i}": kind for i in range(g.classes + 1 if g.classes else 3)}
        ids: dict = {}

        def same(*parts) -> int:
            return ids.setdefault(parts, len(ids))

        # id -> the (grower, tree, node, depth) that share the node
        large: dict[int, list] = {}
        for job, t in work:
            g = growers[job]
            if ranges.sizes[g.store] <= handoff:
                self.depths[job, t, g.root(t)] = 0
            else:
                large.setdefault(same(g.store, g.kind, g.features, g.seed, g.center, g.scale, t), []).append((job, t, g.root(t), 0))
        while large:
            # at most MAX_OPEN rows: the nodes that were large
            found = self._split(large)
            shared, large = large, {}
            for i, users in shared.items():
                for job, t, key, depth in users:
                    if (job, t, key) not in found:
                        continue
                    f, cut, lo, hi, stats, n_lo, n_hi = found[job, t, key]
                    self.moves[job, t][key] = (f, cut, lo, hi)
                    if f < 0:
                        self.leaves[job, t, key] = stats
                        continue
                    for side, child, n in ((0, lo, n_lo), (1, hi, n_hi)):
                        if n > handoff:
                            large.setdefault(same(i, f, cut, side), []).append((job, t, child, depth + 1))
                        else:
                            self.depths[job, t, child] = depth + 1

    def _visits(self, large: dict[int, list]):
        """For a block of rows: every large node's id with its grower, rows, targets and weights."""
        growers, by_tree = self.growers, {}
        for i, users in large.items():
            job, t, key, _ = users[0]
            by_tree.setdefault((job, t), {})[key] = i
        moves = {k: self.moves[k] for k in by_tree}

        def visit(block: pa.Table):
            rid, store, held = (block[c].to_numpy() for c in ("rid", "store", "held"))
            x, y, w = _matrix(block["x"]), block["y"].to_numpy(), block["w"].to_numpy()
            for (job, t), wanted in by_tree.items():
                g = growers[job]
                mine = np.flatnonzero((store == g.store) & ~held)
                if not len(mine):
                    continue
                bag = g.bag(t, rid[mine])
                cells = _reached(moves[job, t], g.root(t), x, mine[bag > 0])
                drawn = np.zeros(len(x))
                drawn[mine] = bag
                for key, at in cells.items():
                    if key in wanted:
                        yield wanted[key], g, x, at, y[at], w[at] * drawn[at]
        return visit

    def _split(self, large: dict[int, list]) -> dict[tuple, tuple]:
        """One level, per (grower, tree, node): feature (-1: a leaf), cut, children, statistics and rows of both sides."""
        growers, stats = self.growers, self.stats
        visit = self._visits(large)

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                for i, g, x, at, y, w in visit(block):
                    v, none = x[at], np.zeros(1)
                    sums = np.zeros((v.shape[1] + 1, len(stats)))
                    sums[0] = g.stats(y, w).sum(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(sums), i, np.int64)), pa.array(np.arange(-1, v.shape[1], dtype=np.int32)),
                         pa.array(np.concatenate([none, v.min(axis=0)])), pa.array(np.concatenate([none, v.max(axis=0)])),
                         *[pa.array(c) for c in sums.T]], names=["id", "f", "lo", "hi", *stats])

        seen = self.rows.mapInArrow(ranges, "id long, f int, lo double, hi double, " + ", ".join(f"{n} double" for n in stats)).groupBy(
            "id", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(n).alias(n) for n in stats]).toArrow().sort_by(
            [("id", "ascending"), ("f", "ascending")])
        ids, first = np.unique(seen["id"].to_numpy(), return_index=True)
        low, high = seen["lo"].to_numpy(), seen["hi"].to_numpy()
        totals = dict(zip(ids.tolist(), np.column_stack([seen[n].to_numpy() for n in stats])[first]))
        picks = {}  # id of a node to split -> candidates in the order drawn, with the cut of ``extra``
        for i, a, b in zip(ids.tolist(), first + 1, np.append(first[1:], len(low))):
            job, _, key, _ = large[i][0]
            if not any(growers[job].splittable(totals[i], depth) for job, _, _, depth in large[i]):
                continue
            g, at, varies = growers[job], np.array([key], np.int64), high[a:b] > low[a:b]
            f = g.candidates(at, varies[None, :])[0]
            f = f[varies[f]]
            picks[i] = [(int(j), float(g.random_cut(at, np.array([j]), low[a:b][[j]], high[a:b][[j]])[0])) for j in f]
        part = self._task()
        part.large, part.totals, part.picks, part.sums = {i: large[i] for i in picks}, {i: totals[i] for i in picks}, picks, self.sums
        best = {tuple(r[:3]): r["cut"] for r in self._cuts(visit, part).groupBy("job", "t", "node").agg(
            F.min(F.struct("share", "rank", "v", "f", "n")).alias("cut")).collect()} if picks else {}
        found = {}
        for i in totals:
            for job, t, key, depth in large[i]:
                g, total, r = growers[job], totals[i], best.get((job, t, key))
                split = r is not None
                share, f, cut, n = (r["share"], r["f"], r["v"], r["n"]) if split else (1.0, -1, 0.0, 0.0)
                lo, hi = (int(k[0]) if split else 0 for k in g.children(np.array([key], np.int64)))
                gain = float(g.loss(total) * (1 - share))
                self.top.append(_node_batch(job, [np.array([t]), np.array([0]), np.array([key]), np.array([depth]), np.array([f]),
                                                  np.array([cut]), np.array([lo]), np.array([hi]), np.array([gain]), total[None, :]]))
                found[job, t, key] = (f, cut, lo, hi, total.tolist(), n, float(total[-1]) - n)
        return found

    def _cuts(self, visit, part: _Levels) -> DataFrame:
        """``(job, t, node, share, rank, v, f, n)``: cuts among which the best of every node is, with the rows below them."""
        picks, edges, names = part.picks, self.ranges.edges, list(self.sums)
        sums = ", ".join(f"{n} {kind}" for n, kind in self.sums.items())

        def batch(i: int, f: int, b, lo, hi, least, most, s: np.ndarray) -> pa.RecordBatch:
            n = len(s)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, f, np.int32)), pa.array(np.asarray(b, np.int32)),
                 *[pa.array(np.asarray(c, float)) for c in (lo, hi, least, most)], *[pa.array(s[:, k]) for k in range(s.shape[1])]],
                names=["id", "f", "b", "lo", "hi", "least", "most", *names])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                for i, g, x, at, y, w in visit(block):
                    if i not in picks:
                        continue
                    s, none = g.exact(y, w), np.zeros(1)
                    z = np.zeros(len(y)) if g.classes else np.rint((y - g.center) * g.scale)
                    yield batch(i, -1, none, none, none, none, none, s.sum(axis=0)[None, :])
                    for f, cut in picks[i]:
                        v = x[at, f]
                        if g.kind == "extra":
                            yield batch(i, f, none, [cut], [cut], none, none, s[v <= cut].sum(axis=0)[None, :])
                            continue
                        b = np.searchsorted(edges[f], v, "right")
                        order = np.argsort(b, kind="stable")
                        starts = np.flatnonzero(np.diff(b[order], prepend=-1))
                        yield batch(i, f, b[order][starts], *[u.reduceat(c[order], starts) for c in (v, z) for u in (np.minimum, np.maximum)],
                                    np.add.reduceat(s[order], starts, axis=0))

        counted = self.rows.mapInArrow(count, f"id long, f int, b int, lo double, hi double, least double, most double, {sums}").groupBy(
            "id", "f", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"),
                                F.max("most").alias("most"), *[F.sum(n).alias(n) for n in names]).checkpoint(eager=True)
        part.wholes = {r["id"]: np.array([r[n] for n in names]) for r in counted.where("f = -1").select("id", *names).collect()}
        columns = ["job", "t", "node", "share", "rank", "v", "f", "n"]
        cuts = "job int, t int, node long, share double, rank int, v double, f int, n double"
        judged = counted.groupBy("id").applyInArrow(lambda table: part.between(table), f"{cuts}, id long, b int, {sums}").checkpoint(eager=True)
        between, unsure = judged.where("job is not null").select(columns), judged.where("job is null").select("id", "f", "b", *names)
        # one bit per range: at most BUCKETS for every candidate of a large node
        opened = {}
        for r in unsure.groupBy("id", "f").agg(F.collect_set("b").alias("b")).collect():
            bits = np.zeros(BUCKETS + 1, bool)
            bits[r["b"]] = True
            opened.setdefault(r["id"], {})[r["f"]] = np.packbits(bits)
        if not opened:
            return between

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                for i, g, x, at, y, w in visit(block):
                    for f, bits in opened.get(i, {}).items():
                        v = x[at, f]
                        b = np.searchsorted(edges[f], v, "right")
                        here = np.flatnonzero(np.unpackbits(bits)[b])
                        if len(here):
                            v, place = np.unique(v[here], return_inverse=True)
                            s = g.exact(y[here], w[here])
                            order = np.argsort(place, kind="stable")
                            s = np.add.reduceat(s[order], np.flatnonzero(np.diff(place[order], prepend=-1)), axis=0)
                            yield batch(i, f, np.searchsorted(edges[f], v, "right"), v, v, v, v, s)

        # a group holds the values of some ranges: few enough for a task however many rows a node has
        inside = self.rows.mapInArrow(values, f"id long, f int, b int, lo double, hi double, least double, most double, {sums}").groupBy(
            "id", "f", "b", F.col("lo").alias("v")).agg(*[F.sum(n).alias(n) for n in names]).withColumn("part", F.expr("b div 16"))
        keys = ["id", "f", "part"]
        return between.unionByName(inside.groupBy(*keys).cogroup(unsure.withColumn("part", F.expr("b div 16")).groupBy(*keys)).applyInArrow(
            lambda table, start: part.within(table, start), cuts))

    def _read(self, table: pa.Table, by: str) -> tuple:
        """Sums of one node's table, sorted by feature and ``by``."""
        table = table.sort_by([("f", "ascending"), (by, "ascending")])
        return table, table["f"].to_numpy(), np.column_stack([table[c].to_numpy() for c in self.sums])

    def _best_cuts(self, i: int, f: np.ndarray, v: np.ndarray, left: np.ndarray, whole: np.ndarray) -> tuple[pa.Table, list[float]]:
        """Per user of node ``i`` the best of some cuts; and all the users' losses there."""
        rank = {f: k for k, (f, _) in enumerate(self.picks[i])}
        ranks = np.array([rank[j] for j in f.tolist()], np.int32)
        rows, losses = [], []
        for job, t, key, depth in self.large[i]:
            g = self.growers[job]
            able = g.splittable(self.totals[i], depth) and len(f)
            share = g.rated(left, whole, self.totals[i]) if able else np.full(len(f), np.inf)
            if able and np.isfinite(share).any():
                k = np.flatnonzero(share == share.min())
                k = int(k[np.lexsort((v[k], ranks[k]))[0]])
                rows.append((job, t, key, float(share[k]), int(ranks[k]), float(v[k]), int(f[k]), float(left[k, -1])))
            if g.splittable(self.totals[i], depth):
                losses.append(float(share.min(initial=np.inf)))
        names = ["job", "t", "node", "share", "rank", "v", "f", "n"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
        return pa.table([pa.array([r[k] for r in rows], types[k]) for k in range(8)], names=names), losses

    def between(self, table: pa.Table) -> pa.Table:
        """The best cuts of a node at the ends of ranges; and the ranges that may hold better ones, with the sums before them."""
        i = table["id"][0].as_py()
        table, f, s = self._read(table, "b")
        whole, table, f, s = s[0], table.slice(1), f[1:], s[1:]
        lo, hi, g = table["lo"].to_numpy(), table["hi"].to_numpy(), self.growers[self.large[i][0][0]]
        if g.kind == "extra":
            cuts, losses, left, unsure = *self._best_cuts(i, f, lo, s, whole), s, np.zeros(len(f), bool)
        else:
            left = np.cumsum(s, axis=0)
            first = np.searchsorted(f, f)
            left -= (left - s)[first]
            inner = np.flatnonzero(f[1:] == f[:-1])
            cuts, losses = self._best_cuts(i, f[inner], _middle(hi[inner], lo[inner + 1]), left[inner], whole)
            left -= s
            floor = g.floor(left, s, whole, self.totals[i], table["least"].to_numpy(), table["most"].to_numpy())
            unsure = (hi > lo) & (floor <= max(losses, default=-np.inf))
        at = np.flatnonzero(unsure)
        more = pa.table([table["id"].take(at), table["f"].take(at), table["b"].take(at), *[pa.array(left[at, k]) for k in range(s.shape[1])]],
                        names=["id", "f", "b", *self.sums])
        both = pa.concat_tables([cuts, more], promote_options="default")
        return both.select([*cuts.column_names, "id", "b", *self.sums])

    def within(self, table: pa.Table, start: pa.Table) -> pa.Table:
        """The best cuts inside some ranges of one feature, from the sums of their values and the sums before each range."""
        i = start["id"][0].as_py()
        table, f, s = self._read(table, "v")
        start, _, before = self._read(start, "b")
        b, v = table["b"].to_numpy(), table["v"].to_numpy()
        left = np.cumsum(s, axis=0)
        left += (before[np.searchsorted(start["b"].to_numpy(), b)]) - (left - s)[np.searchsorted(b, b)]
        inner = np.flatnonzero(b[1:] == b[:-1])
        return self._best_cuts(i, f[inner], _middle(v[inner], v[inner + 1]), left[inner], self.wholes[i])[0]

    def _dealt(self, held_too: bool) -> DataFrame:
        """The rows of every node left, packed by blocks: rid, target, weight, held and features, column after column."""
        growers, work, moves, depths, leaves = self.growers, self.work, self.moves, self.depths, self.leaves

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                rid, store, held = (block[c].to_numpy() for c in ("rid", "store", "held"))
                table = np.vstack([np.ascontiguousarray(rid).view(float), block["y"].to_numpy(), block["w"].to_numpy(),
                                   held.astype(float), _matrix(block["x"]).T])
                x = table[4:].T
                for job, t in work:
                    g = growers[job]
                    mine = np.flatnonzero((store == g.store) & ~held)
                    mine = mine[g.bag(t, rid[mine]) > 0]
                    if held_too:
                        mine = np.concatenate([mine, np.flatnonzero((store == g.store) & held)])
                    cells = _reached(moves[job, t], g.root(t), x, mine)
                    keys = [k for k, at in cells.items() if (job, t, k) in depths or (held_too and (job, t, k) in leaves and held[at].any())]
                    if keys:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), job, np.int32)), pa.array(np.full(len(keys), t, np.int32)),
                             pa.array(keys, pa.int64()), pa.array(np.full(len(keys), len(table), np.int32)),
                             pa.array([table[:, cells[k]].tobytes() for k in keys], pa.binary())],
                            names=["job", "t", "node", "wide", "packed"])

        # a number of parts of our own: merged by their bytes, few tasks would finish all the nodes
        return self.rows.mapInArrow(deal, "job int, t int, node long, wide int, packed binary").repartition(
            max(1, min(len(depths), FINISH_PARTS)), "job", "t", "node")

    def _finish(self, table: pa.Table) -> tuple:
        """Grower, nodes below (none: a leaf) and held rows ``rid, x, y`` of one group."""
        job, t, key = (table[c][0].as_py() for c in ("job", "t", "node"))
        cells = np.concatenate([np.frombuffer(b).reshape(w, -1) for w, b in zip(table["wide"].to_pylist(), table["packed"].to_pylist())],
                               axis=1)
        cells = cells[:, np.argsort(np.ascontiguousarray(cells[0]).view(np.int64), kind="stable")]
        held = cells[3] > 0
        rid, x = np.ascontiguousarray(cells[0]).view(np.int64), np.ascontiguousarray(cells[4:].T)
        g, nodes = self.growers[job], None
        if (job, t, key) in self.depths:
            learn = ~held
            y, w = cells[1, learn], cells[2, learn] * g.bag(t, rid[learn])
            nodes = grow(g, job, [t], [key], x[learn], g.stats(y, w), np.zeros(len(y), np.int64), self.depths[job, t, key],
                         g.steps(y, w))
        return job, t, key, nodes, (rid[held], x[held], cells[1, held])

    def _task(self) -> _Levels:
        """What the grouped tasks need: growers, depths and leaves, no table."""
        out = object.__new__(_Levels)
        out.growers, out.depths, out.leaves = self.growers, self.depths, self.leaves
        return out

    def nodes(self) -> DataFrame:
        part, empty = self._task(), NODES
        below = self._dealt(False).groupBy("job", "t", "node").applyInArrow(
            lambda table: pa.Table.from_batches([part._finish(table)[3]]), empty)
        spark = self.rows.sparkSession
        return below.unionByName(spark.createDataFrame(pa.Table.from_batches(self.top), NODES)) if self.top else below

    def held_values(self, width: int) -> DataFrame:
        """``(job, rid, y, trees, v0..)``: per held row the sums over the trees of this wave."""
        part, names = self._task(), [f"v{i}" for i in range(width)]

        def score(table: pa.Table) -> pa.Table:
            job, t, key, nodes, (rid, x, y) = part._finish(table)
            g = part.growers[job]
            value = np.zeros((len(rid), width))
            if len(rid):
                found = Packed(pa.Table.from_batches([nodes]), g.classes, g.center).predict(x) if nodes is not None else node_values(
                    np.array([part.leaves[job, t, key]]), g.classes, g.center)
                value[:, :found.shape[1]] = found
            return pa.table([pa.array(np.full(len(rid), job, np.int32)), pa.array(rid), pa.array(y),
                             *[pa.array(value[:, i]) for i in range(width)]], names=["job", "rid", "y", *names])

        each = self._dealt(True).groupBy("job", "t", "node").applyInArrow(
            score, "job int, rid long, y double, " + ", ".join(f"{n} double" for n in names))
        return each.groupBy("job", "rid").agg(F.first("y").alias("y"), F.count(F.lit(1)).alias("trees"),
                                              *[F.sum(n).alias(n) for n in names])


def _reached(moves: dict, root: int, x: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """The rows at every node where a tree's splits known so far end."""
    out, todo = {}, [(root, rows)]
    while todo:
        key, at = todo.pop()
        step = moves.get(key)
        if step is None or step[0] < 0:
            if len(at):
                out[key] = at
            continue
        f, cut, lo, hi = step
        low = x[at, f] <= cut
        todo += [(lo, at[low]), (hi, at[~low])]
    return out


# ---------------------------------------------------------------- scoring

def node_values(stats: np.ndarray, classes: int, center: float) -> np.ndarray:
    """Class shares, or the mean, of nodes."""
    if classes:
        c = stats[:, :-1]
        return c / c.sum(axis=1, keepdims=True)
    return (stats[:, 1] / stats[:, 0] + center)[:, None]


class Packed:
    """Nodes of some trees (or subtrees) as arrays; ``start`` holds the position of each root."""

    def __init__(self, nodes: pa.Table, classes: int, center: float):
        t, key = nodes["t"].to_numpy(), nodes["node"].to_numpy()
        order = np.lexsort((key, t))
        t, key = t[order], key[order]
        self.t, self.key = t, key
        self.f, self.cut = nodes["f"].to_numpy()[order], nodes["cut"].to_numpy()[order]
        self.depth = nodes["depth"].to_numpy()[order]
        self.value = node_values(_matrix(nodes["stats"])[order], classes, center)
        stats = _matrix(nodes["stats"])[order]
        self.cover = stats[:, :-1].sum(axis=1) if classes else stats[:, 0]
        self.to = np.column_stack([nodes["lo"].to_numpy()[order], nodes["hi"].to_numpy()[order]])
        tree_at = np.searchsorted(t, np.unique(t))
        bounds = np.append(tree_at, len(t))
        self.child = np.zeros((len(t), 2), np.int64)
        for side in (0, 1):
            to = self.to[:, side]
            for a, b in zip(bounds[:-1], bounds[1:]):
                at = a + np.searchsorted(key[a:b], to[a:b])
                at = np.minimum(at, b - 1)
                self.child[a:b, side] = np.where((self.f[a:b] >= 0) & (key[at] == to[a:b]), at, -1)
        self.start = np.array([a + int(np.argmin(self.depth[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)

    def leaf(self, x: np.ndarray, start: int) -> np.ndarray:
        """Position reached by every row: a leaf, or a split whose child lies elsewhere."""
        at = np.full(len(x), start)
        live = np.flatnonzero(self.f[at] >= 0)
        while len(live):
            here = at[live]
            to = self.child[here, (x[live, self.f[here]] > self.cut[here]).astype(np.int64)]
            on = to >= 0
            live, to = live[on], to[on]
            at[live] = to
            live = live[self.f[to] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values averaged over trees."""
        return sum(self.value[self.leaf(x, s)] for s in self.start) / max(len(self.start), 1)


def packed_bytes(nodes: DataFrame) -> int:
    row = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("stats")).alias("k")).first()
    return row["n"] * (8 * (row["k"] or 0) + 48)


def held_out_values(rows: DataFrame, nodes: DataFrame, growers: Sequence[Grower]) -> DataFrame:
    """``(job, rid, y, value)`` of each grower's held rows: class shares or one mean, averaged over trees.

    Trees stay where they are: each group holds one tree part and the rows that pass it (see ``_by_subtree``).
    """
    jobs = rows.sparkSession.createDataFrame([(i, g.store) for i, g in enumerate(growers)], "job int, store int")
    asked = rows.where("held").join(F.broadcast(jobs), "store").select("job", "rid", "x", "y")
    return _by_subtree(asked, nodes, list(growers)).join(asked.select("job", "rid", "y"), ["job", "rid"])


#: Rows that one group sends down a tree part.
SCORED_ROWS = 200_000


def _by_subtree(asked: DataFrame, nodes: DataFrame, growers: Sequence[Grower]) -> DataFrame:
    """``(job, rid, value)`` for ``asked (job, rid, x)``, one group per tree part; no group holds a whole forest.

    Parts of the levels that all rows pass (``sub = 0``) are few and sent to
    every task after a size check by their number (at most ``MAX_OPEN`` a wave).
    The rows of one forest are sent to all tasks as well if they fit; only its nodes are shuffled then.
    """
    spark = asked.sparkSession
    nodes = nodes.select("job", "t", "sub", "node", "depth", "f", "cut", "lo", "hi", "stats")
    tops = nodes.where("sub = 0").toArrow()
    trees = {i: g.trees for i, g in enumerate(growers)}
    info = [(g.classes, g.center) for g in growers]
    roots = [[g.root(t) for t in range(g.trees)] for g in growers]

    def route(batches):
        by = {}
        if tops.num_rows:
            jt = tops["job"].to_numpy()
            for job in np.unique(jt):
                by[int(job)] = Packed(tops.filter(pa.array(jt == job)), *info[job])
        for b in batches:
            jobs = b["job"].to_numpy()
            for job in np.unique(jobs):
                mine = b.filter(pa.array(jobs == job))
                x = _matrix(mine["x"])
                for t in range(trees[int(job)]):
                    sub, value = np.full(len(x), roots[job][t], np.int64), None
                    if int(job) in by:
                        p = by[int(job)]
                        at = p.leaf(x, p.start[np.searchsorted(np.unique(p.t), t)])
                        side = (x[np.arange(len(x)), p.f[at]] > p.cut[at]).astype(np.int64)
                        sub = np.where(p.f[at] >= 0, p.to[at, side], 0)
                        value = p.value[at]
                    yield _asked_batch(mine, t, sub, value, info[job])

    k = max((g.classes or 1) for g in growers)
    means = [F.avg(f"v{i}").alias(f"v{i}") for i in range(k)]
    value = F.array(*[f"v{i}" for i in range(k)]).alias("value")
    if len(growers) == 1 and _fits(asked, 1 << 40):
        table = asked.select("rid", "x").toArrow()
        shared = spark.sparkContext.broadcast((table["rid"].to_numpy(), _matrix(table["x"])))

        def below_here(held_here: pa.Table) -> pa.Table:
            rid, x = shared.value
            t, sub, p = held_here["t"][0].as_py(), held_here["sub"][0].as_py(), Packed(held_here, *info[0])
            mine = np.arange(len(x))
            if sub != roots[0][t]:  # the rows that come here through the levels above
                top = Packed(tops.filter(pa.array(tops["t"].to_numpy() == t)), *info[0])
                at = top.leaf(x, top.start[0])
                side = (x[mine, np.maximum(top.f[at], 0)] > top.cut[at]).astype(np.int64)
                mine = np.flatnonzero((top.f[at] >= 0) & (top.to[at, side] == sub))
            v = p.value[p.leaf(x[mine], p.start[0])] if len(mine) else np.zeros((0, k))
            return pa.table([pa.array(rid[mine]), *[pa.array(v[:, i]) for i in range(k)]], names=["rid", *[f"v{i}" for i in range(k)]])

        def leaves_here(batches):
            rid, x = shared.value
            for b in batches:
                for t in b.column(0).to_pylist():
                    top = Packed(tops.filter(pa.array(tops["t"].to_numpy() == t)), *info[0])
                    at = top.leaf(x, top.start[0])
                    v, mine = top.value[at], np.flatnonzero(top.f[at] < 0)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[mine]), *[pa.array(v[mine, i]) for i in range(k)]],
                                                     names=["rid", *[f"v{i}" for i in range(k)]])

        cells = "rid long, " + ", ".join(f"v{i} double" for i in range(k))
        every = nodes.where("sub <> 0").groupBy("t", "sub").applyInArrow(below_here, cells)
        if tops.num_rows:
            held = [(t,) for t in np.unique(tops["t"].to_numpy()).tolist()]
            every = every.unionByName(spark.createDataFrame(held, "t int").mapInArrow(leaves_here, cells))
        return every.groupBy("rid").agg(*means).select(F.lit(0).alias("job"), "rid", value)

    width = "job int, rid long, t int, sub long, x array<double>, value array<double>"
    routed = asked.select("job", "rid", "x").mapInArrow(route, width).checkpoint(eager=True)
    done = routed.where("sub = 0").select("job", "rid", "value")
    busy = routed.where("sub <> 0").groupBy("job", "t", "sub").agg(
        F.ceil(F.count(F.lit(1)) / SCORED_ROWS).cast("long").alias("parts"))
    ask = routed.where("sub <> 0").drop("value").join(busy, ["job", "t", "sub"]).withColumn(
        "part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
    hold = nodes.where("sub <> 0").join(busy, ["job", "t", "sub"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts")

    def score(asked_here: pa.Table, held_here: pa.Table) -> pa.Table:
        if not asked_here.num_rows or not held_here.num_rows:
            return pa.table({"job": pa.array([], pa.int32()), "rid": pa.array([], pa.int64()),
                             "value": pa.array([], pa.list_(pa.float64()))})
        p = Packed(held_here, *info[asked_here["job"][0].as_py()])
        v = p.value[p.leaf(_matrix(asked_here["x"]), p.start[0])]
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1)))
        return pa.table({"job": asked_here["job"], "rid": asked_here["rid"], "value": cells})

    keys = ["job", "t", "sub", "part"]
    below = ask.groupBy(*keys).cogroup(hold.groupBy(*keys)).applyInArrow(score, "job int, rid long, value array<double>")
    every = done.unionByName(below)
    return every.groupBy("job", "rid").agg(*[F.avg(F.col("value")[i]).alias(f"v{i}") for i in range(k)]).select("job", "rid", value)


def _asked_batch(mine: pa.RecordBatch, t: int, sub: np.ndarray, value: np.ndarray | None, info: tuple) -> pa.RecordBatch:
    n = mine.num_rows
    if value is None:
        cells = pa.nulls(n, pa.list_(pa.float64()))
    else:
        cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * value.shape[1]), pa.array(value.reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [mine["job"], mine["rid"], pa.array(np.full(n, t, np.int32)), pa.array(sub), mine["x"], cells],
        names=["job", "rid", "t", "sub", "x", "value"])


# ---------------------------------------------------------------- estimators

class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol):
    kind = Param(Params._dummy(), "kind", "'extra', 'forest' or 'tree'", typeConverter=TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "maximum depth (0: none)", typeConverter=TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "minimum rows per child",
                                typeConverter=TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "'sqrt', 'all' or a fraction", typeConverter=TypeConverters.toString)
    handoff = Param(Params._dummy(), "handoff", "rows of a node that one task finishes", typeConverter=TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes (0: regression)", typeConverter=TypeConverters.toInt)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of features", typeConverter=TypeConverters.toInt)
    center = Param(Params._dummy(), "center", "mean of the training target", typeConverter=TypeConverters.toFloat)
    nodesPath = Param(Params._dummy(), "nodesPath", "where the node table lies", typeConverter=TypeConverters.toString)


class ForestEstimator(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Classifier or regressor over ``kind`` of trees; ``classifier`` labels are class indexes."""

    classifier = True

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", kind="forest", numTrees=100, maxDepth=0, minInstancesPerNode=1,
                 maxFeatures=None, handoff=HANDOFF, seed=42, weightCol=None):
        super().__init__()
        self._setDefault(kind="forest", numTrees=100, maxDepth=0, minInstancesPerNode=1, handoff=HANDOFF,
                         maxFeatures="sqrt" if self.classifier else "all")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _weight(self) -> str | None:
        return self.getOrDefault(self.weightCol) if self.isDefined(self.weightCol) else None

    def grower(self, p: int, classes: int, center: float, scale: float, store: int = -1) -> Grower:
        mf = "all" if self.getOrDefault(self.kind) == "tree" else self.getOrDefault(self.maxFeatures)
        m = p if mf == "all" else max(1, int(math.sqrt(p))) if mf == "sqrt" else max(1, int(float(mf) * p))
        trees = 1 if self.getOrDefault(self.kind) == "tree" else self.getOrDefault(self.numTrees)
        return Grower(self.getOrDefault(self.kind), classes, trees, self.getOrDefault(self.maxDepth),
                      self.getOrDefault(self.minInstancesPerNode), m, self.getOrDefault(self.seed), store, center, scale)

    def _fit(self, df: DataFrame) -> ForestModel:
        rows = forest_rows(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        seen = rows.agg(F.max("y").alias("k"), F.min("y").alias("least"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("p")).first()
        if seen["p"] is None:
            raise ValueError("no training row has a label")
        classes = int(seen["k"]) + 1 if self.classifier else 0
        g = self.grower(seen["p"], classes, *((0.0, 1.0) if classes else target_steps(seen["least"], seen["mean"], seen["k"])))
        path = scratch_dir(df.sparkSession, "forest")
        _grown(rows, [g], self.getOrDefault(self.handoff)).write.parquet(path)
        model = ForestModel()
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
                   probabilityCol=self.getProbabilityCol(), kind=g.kind, numTrees=g.trees, maxDepth=g.max_depth,
                   minInstancesPerNode=g.min_rows, seed=g.seed, numClasses=classes, numFeatures=seen["p"],
                   center=g.center, nodesPath=path)
        return model


class ForestClassifier(ForestEstimator):
    classifier = True


class ForestRegressor(ForestEstimator):
    classifier = False


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.nodes().write.parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._set(nodesPath=f"{path}/nodes")
        return model


class ForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted forest; its node table is saved and loaded with it."""

    def __init__(self):
        super().__init__()

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)

    def nodes(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().read.parquet(self.getOrDefault(self.nodesPath))

    @property
    def featureImportances(self) -> DenseVector:
        """Impurity decrease per feature, normalised per tree, averaged over trees."""
        gains = self.nodes().where("f >= 0").groupBy("t", "f").agg(F.sum("gain").alias("g"))
        sums = gains.groupBy("t").agg(F.sum("g").alias("all"))
        per = gains.join(sums, "t").where("`all` > 0").groupBy("f").agg(F.sum(F.col("g") / F.col("all")).alias("g")).collect()
        out = np.zeros(self.getOrDefault(self.numFeatures))
        for r in per:
            out[r["f"]] = r["g"]
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def _grower(self) -> Grower:
        return Grower(self.getOrDefault(self.kind), self.getOrDefault(self.numClasses), self.getOrDefault(self.numTrees),
                      seed=self.getOrDefault(self.seed), center=self.getOrDefault(self.center))

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        classes, center = self.getOrDefault(self.numClasses), self.getOrDefault(self.center)
        arr = F.transform(_features_array(df, self.getFeaturesCol()), lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
        nodes = self.nodes()
        if packed_bytes(nodes) <= BROADCAST_BYTES:
            table = nodes.select("t", "node", "depth", "f", "cut", "lo", "hi", "stats").toArrow()
            shared = df.sparkSession.sparkContext.broadcast(Packed(table, classes, center))

            @F.arrow_udf("array<double>")
            def values(x: pa.Array) -> pa.Array:
                if not len(x):
                    return pa.array([], pa.list_(pa.float64()))
                v = shared.value.predict(_matrix(x))
                return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]),
                                                pa.array(v.reshape(-1)))

            out = df.withColumn("__forest", values(arr))
        else:
            checkpoint_root(df.sparkSession)
            keyed = df.withColumns({"__rid": F.monotonically_increasing_id(), "__x": arr}).checkpoint(eager=True)
            scored = _by_subtree(keyed.select(F.lit(0).alias("job"), F.col("__rid").alias("rid"), F.col("__x").alias("x")),
                                 nodes, [self._grower()])
            out = keyed.drop("__x").join(scored.select(F.col("rid").alias("__rid"), F.col("value").alias("__forest")),
                                         "__rid", "left").drop("__rid")
        v = F.col("__forest")
        if classes:
            return out.withColumns({self.getPredictionCol(): (F.array_position(v, F.array_max(v)) - 1).cast("double"),
                                    self.getProbabilityCol(): array_to_vector(v)}).drop("__forest")
        return out.withColumn(self.getPredictionCol(), v[0]).drop("__forest")
