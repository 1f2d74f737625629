"""Toxicity by non-negative positive-unlabelled learning over hashed word features.

Training sees confirmed toxic documents (positives) and texts without labels.
The risk of a classifier g is estimated as
``prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])``; while
the second part is negative, its gradient is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches
from quarry.llm.textkit import Words, mix, slices, utf8_rows, words_of

#: Byte prefixes of words that count as features beside whole words.
PREFIXES = (4, 5)


@dataclass
class ToxicityModel:
    """Sorted feature hashes, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        """Probability per row: each feature counts once in a text, however long."""
        total = np.full(len(words.offsets) - 1, self.bias)
        if len(self.features):
            sieve = np.zeros(1 << 18, bool)
            sieve[(self.features & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            rows, hits = [], []
            for row, h in word_features(words):
                at = np.flatnonzero(sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
                pos = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
                true = self.features[pos] == h[at]
                rows.append(row[at][true])
                hits.append(pos[true])
            pairs = np.unique(np.concatenate(rows) * len(self.features) + np.concatenate(hits))
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def word_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, hash)`` of whole words and of their byte prefixes."""
    yield words.row, words.hashes()
    for n in PREFIXES:
        long = words.end - words.start > n
        start = words.start[long]
        yield words.row[long], mix(words.span_hash(start, start + n) + np.uint64(n))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_rows(batch.column("text"))
        out = []
        for a, b in slices(offsets):
            parts = list(word_features(words_of(raw, offsets, a, b)))
            row, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(row, kind="stable")
            edges = np.searchsorted(row[order], np.arange(b - a + 1))
            out += [np.unique(h[order[edges[i]:edges[i + 1]]]).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(out, pa.binary())], ["positive", "features"])


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_docs: int = 8,
             min_z: float = 4.0, min_lift: float = 8.0, max_features: int = 20_000, steps: int = 1_500,
             rate: float = 0.1, l2: float = 1e-4) -> ToxicityModel:
    """Train a linear classifier on sets of feature hashes (non-negative PU risk, logistic loss, Adam).

    A feature's share among negatives is the class-prior correction of its
    unlabelled share, ``(u - prior * p) / (1 - prior)``. Features enter that
    stand in ``min_docs`` positives, whose positive share exceeds the negative
    one by ``min_z`` standard errors and ``min_lift`` times; the
    ``max_features`` of highest z stay.
    """
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -20.0)
    if not positive or not unlabelled:
        return none
    ids, in_p = np.unique(np.concatenate(positive), return_counts=True)
    ids, in_p = ids[in_p >= min_docs], in_p[in_p >= min_docs]
    all_u, count_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    pos = np.minimum(np.searchsorted(all_u, ids), max(len(all_u) - 1, 0))
    in_u = np.where(all_u[pos] == ids, count_u[pos], 0) if len(all_u) else np.zeros(len(ids))
    p, u = in_p / len(positive), in_u / len(unlabelled)
    negative_share = np.maximum((u - prior * p) / (1 - prior), 0)
    error = np.sqrt(p * (1 - p) / len(positive) + u * (1 - u) / len(unlabelled) / (1 - prior) ** 2 + 1e-12)
    z = (p - negative_share) / error
    keep = np.flatnonzero((z >= min_z) & (p >= min_lift * np.maximum(negative_share, 0.5 / len(unlabelled))))
    keep = np.sort(keep[np.argsort(-z[keep], kind="stable")[:max_features]])
    ids = ids[keep]
    if not len(ids):
        return none

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for r, s in enumerate(sets):
            at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
            hit = at[ids[at] == s]
            rows.append(np.full(len(hit), r))
            cols.append(hit)
        return np.concatenate(rows), np.concatenate(cols)
    data = [(*matrix(positive), len(positive)), (*matrix(unlabelled), len(unlabelled))]
    w = np.zeros(len(ids) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def margin(x) -> np.ndarray:
        return np.bincount(x[0], w[x[1]], x[2]) + w[-1]

    def pull(x, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[1], g[x[0]], len(ids)), g.sum()) / x[2]
    for t in range(1, steps + 1):
        gp, gu = margin(data[0]), margin(data[1])
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_negative = pull(data[1], su) - prior * pull(data[0], sp)
        grad = prior * pull(data[0], sp - 1) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # every feature that entered speaks for toxicity
    return ToxicityModel(ids, w[:-1].copy(), float(w[-1]))


def _sample_texts(docs: DataFrame, positives: DataFrame, ids: DataFrame, id_col: str, text_col: str, max_positive: int,
                  max_unlabelled: int) -> DataFrame:
    """``positive, text``: one text per sampled id, at most ``max_positive`` and ``max_unlabelled`` of them."""
    first = positives.distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_positive).withColumn("positive", F.lit(1))
    others = ids.distinct().orderBy(F.xxhash64(F.lit(1), "_id"), "_id").limit(max_unlabelled).withColumn("positive", F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the sample has max_positive + max_unlabelled rows at most
    found = docs.select(F.col(id_col).alias("_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(
        F.broadcast(first.union(others)), "_id")
    return found.groupBy("positive", "_id").agg(F.min("t").alias("t")).select("positive", "t.text")


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   folds: int = 5, max_positive: int = 4_000, max_unlabelled: int = 8_000, **fit) -> ToxicityModel:
    """Fit the classifier on a bounded sample.

    Positives are at most ``max_positive`` documents whose label ``toxic`` is
    1, unlabelled texts at most ``max_unlabelled`` documents, both the first
    by a hash of the id, only from ids whose crc32 modulo ``folds`` is not 0.
    An id that repeats counts once, by its text of smallest hash.
    The class prior is the share of toxic among all labelled training rows.
    The sample is gathered in one task. Null ids and null labels teach nothing,
    a null text counts as empty. Without positives, or from an empty table, the
    model gives every text the same score, near 0.
    """
    def learnable(c: str):
        return F.crc32(F.col(c).cast("string").cast("binary")) % folds != 0
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isNotNull() & learnable("_id"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    texts = _sample_texts(docs, known.where("toxic = 1").select("_id"), docs.select(F.col(id_col).alias("_id")).where(learnable("_id")),
                          id_col, text_col, max_positive, max_unlabelled)
    small_batches(docs.sparkSession)
    rows = texts.mapInArrow(_feature_rows, "positive int, features binary")

    def fit_all(part: pd.DataFrame) -> pd.DataFrame:
        # equal feature sets count once: a text copied often must not teach its chance words
        sets = [[np.frombuffer(f, np.uint64) for f in part["features"][part["positive"] == side].drop_duplicates()] for side in (1, 0)]
        model = nnpu_fit(*sets, prior=min(max(prior, 1e-6), 1 - 1e-6), **fit)
        return pd.DataFrame({"features": [model.features.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})
    got = rows.groupBy().applyInPandas(fit_all, "features binary, weights binary, bias double").collect()
    if not got or prior <= 0:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    return ToxicityModel(np.frombuffer(got[0]["features"], np.uint64), np.frombuffer(got[0]["weights"]), got[0]["bias"])


def _batch_scores(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    raw, offsets = utf8_rows(column)
    parts = [model.scores(words_of(raw, offsets, a, b)) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row from its whole text alone.

    Null and empty texts get the score of a text without features. Rows of
    equal id are scored one by one; other columns are ignored.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_batch_scores(batch.column("text"), model))],
                                             ["doc_id", "score"])
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``, all columns unchanged, whatever their names.

    Null and empty texts have the score of a text without features; repeated
    rows are judged one by one; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(batch.column(text_col), model) < threshold))
    return docs.mapInArrow(run, docs.schema)
