"""Learners MLlib lacks, as ``pyspark.ml`` estimators built from Spark jobs.

* ``GaussianNB`` -- exact: class priors, means and population variances from
  one ``groupBy(label)``; scoring is column arithmetic over learned literals.
* ``KNNClassifier`` -- exact k nearest neighbours by blocked nested loops:
  test rows hash into A blocks, training rows into B blocks; each (a, b) pair
  of blocks is one bounded group scored with NumPy, emitting only the local
  top k per test row; a final top k per test row merges the B partial lists.
  No pair rows are materialised and no group holds a whole side.
* ``RandomFourierFeatures`` -- RBF kernel approximation (Rahimi & Recht, 2007)
  via an Arrow-batched pandas UDF, used with ``LinearSVC`` (one-vs-rest) and
  Huber ``LinearRegression`` for the kernel SVM / SVR re-aims.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# GaussianNB variance smoothing share, default neighbour count.
VAR_SMOOTHING = 1e-9
KNN_K = 5


def _features_array(df: DataFrame, col: str) -> F.Column:
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


def _argmax_expr(scores: list[F.Column]) -> F.Column:
    """Index of the largest score (first on ties), for short cheap score lists."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(None).cast("double")
    for i in reversed(range(len(scores))):
        out = F.when(scores[i] == best, F.lit(float(i))).otherwise(out)
    return out


def _score_outputs(df: DataFrame, scores: list[F.Column], prediction: str, probability: str | None,
                   softmax: bool) -> DataFrame:
    """Materialise class scores once as an array, then argmax (first on ties) and probabilities.

    Keeping the scores in one array column stops large per-class expressions
    from being copied into every comparison.
    """
    tmp = "__scores"
    d = df.withColumn(tmp, F.array(*scores))
    arr = F.col(tmp)
    out = {prediction: (F.array_position(arr, F.array_max(arr)) - 1).cast("double")}
    if probability:
        if softmax:
            e = F.transform(arr, lambda v: F.exp(v - F.array_max(arr)))
        else:
            e = arr
        total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
        out[probability] = array_to_vector(F.transform(e, lambda v: v / total))
    return d.withColumns(out).drop(tmp)


class _ClassifierParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    pass


# ---------------------------------------------------------------- Gaussian naive Bayes

class _NBParams(_ClassifierParams):
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", typeConverter=TypeConverters.toInt)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of features", typeConverter=TypeConverters.toInt)
    logPriors = Param(Params._dummy(), "logPriors", "log class priors", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "class means, row-major", typeConverter=TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "smoothed class variances, row-major",
                      typeConverter=TypeConverters.toListFloat)


class GaussianNB(Estimator, _NBParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian naive Bayes; the label must be a class index 0..k-1."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "GaussianNBModel":
        x = _features_array(df, self.getFeaturesCol())
        data = df.select(x.alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        p = len(data.select("x").first()["x"])
        cols = [F.col("x")[j] for j in range(p)]
        per = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(cols)],
                                    *[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(cols)]).collect()
        overall = data.agg(*[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(cols)]).first()
        eps = VAR_SMOOTHING * max(float(overall[f"v{j}"] or 0.0) for j in range(p))
        k = max(r["y"] for r in per) + 1
        total = sum(r["n"] for r in per)
        by = {r["y"]: r for r in per}
        log_priors, means, variances = [], [], []
        for c in range(k):
            r = by.get(c)
            log_priors.append(math.log(r["n"] / total) if r else -1e300)
            means += [float(r[f"m{j}"]) if r else 0.0 for j in range(p)]
            variances += [float(r[f"v{j}"]) + eps if r else 1.0 for j in range(p)]
        return GaussianNBModel(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                               predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
                               numClasses=k, numFeatures=p, logPriors=log_priors, means=means, variances=variances)


class GaussianNBModel(Model, _NBParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", numClasses=None, numFeatures=None, logPriors=None, means=None,
                 variances=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def joint_log_likelihood(self, x: F.Column) -> list[F.Column]:
        k, p = self.getOrDefault(self.numClasses), self.getOrDefault(self.numFeatures)
        lp, mu, var = (self.getOrDefault(self.logPriors), self.getOrDefault(self.means),
                       self.getOrDefault(self.variances))
        out = []
        for c in range(k):
            const = lp[c] - 0.5 * sum(math.log(2 * math.pi * var[c * p + j]) for j in range(p))
            # array literals keep the generated code the same size for any number of features
            offsets = F.zip_with(x, F.lit(mu[c * p:(c + 1) * p]), lambda v, m: (v - m) * (v - m))
            terms = F.zip_with(offsets, F.lit([2 * v for v in var[c * p:(c + 1) * p]]), lambda o, v: o / v)
            out.append(F.lit(const) - F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        tmp = "__nb_x"
        d = df.withColumn(tmp, _features_array(df, self.getFeaturesCol()))
        out = _score_outputs(d, self.joint_log_likelihood(F.col(tmp)), self.getPredictionCol(),
                             self.getProbabilityCol(), softmax=True)
        return out.drop(tmp)


# ---------------------------------------------------------------- exact KNN

class _KNNParams(_ClassifierParams):
    k = Param(Params._dummy(), "k", "number of neighbours", typeConverter=TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", typeConverter=TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "target rows per block on each side (bounds every group)",
                      typeConverter=TypeConverters.toInt)
    trainRows = Param(Params._dummy(), "trainRows", "number of training rows", typeConverter=TypeConverters.toInt)
    trainPath = Param(Params._dummy(), "trainPath", "where the fitted training rows are stored",
                      typeConverter=TypeConverters.toString)


def _block_topk(k: int):
    def run(key, test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if test.empty or train.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "tid": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64"), "y": pd.Series([], dtype="int32")})
        a = np.stack(test["x"].to_numpy()).astype(np.float64)
        b = np.stack(train["x"].to_numpy()).astype(np.float64)
        # screen with the expanded form (one matrix product), then recompute the
        # short list exactly so near-ties are ordered by true distance
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
        kk = min(k, b.shape[0])
        short = min(b.shape[0], kk + 8)
        cand = np.argpartition(d2, short - 1, axis=1)[:, :short] if short < b.shape[0] else \
            np.broadcast_to(np.arange(b.shape[0]), (a.shape[0], b.shape[0]))
        exact = np.sqrt(((a[:, None, :] - b[cand]) ** 2).sum(-1))
        tid = train["tid"].to_numpy()
        order = np.lexsort((tid[cand], exact), axis=1)[:, :kk]
        picked = np.take_along_axis(cand, order, axis=1)
        dist = np.take_along_axis(exact, order, axis=1)
        return pd.DataFrame({"qid": np.repeat(test["qid"].to_numpy(), kk), "tid": tid[picked.reshape(-1)],
                             "dist": dist.reshape(-1), "y": train["y"].to_numpy()[picked.reshape(-1)].astype("int32")})
    return run


class KNNClassifier(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact k-nearest-neighbour majority vote (Euclidean; ties to the smaller training key, vote ties to the smaller class)."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", k=KNN_K, blockRows=4096, trainPath=None):
        super().__init__()
        self._setDefault(k=KNN_K, blockRows=4096)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KNNModel":
        from quarry.session import scratch_dir

        train = df.select(F.xxhash64(_features_array(df, self.getFeaturesCol()), F.col(self.getLabelCol()))
                          .alias("tid"), _features_array(df, self.getFeaturesCol()).alias("x"),
                          F.col(self.getLabelCol()).cast("int").alias("y"))
        path = self.getOrDefault(self.trainPath) if self.isDefined(self.trainPath) else scratch_dir(df.sparkSession, "knn")
        # blocks go by row number, so equal rows spread over them
        train.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        stats = df.agg(F.max(F.col(self.getLabelCol()).cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).first()
        return KNNModel(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                        predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
                        k=self.getOrDefault(self.k), numClasses=int(stats["k"]) + 1,
                        blockRows=self.getOrDefault(self.blockRows), trainRows=int(stats["n"]), trainPath=path)


class _KNNWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        SparkSession.getActiveSession().read.parquet(
            self.instance.getOrDefault(self.instance.trainPath)).write.parquet(f"{path}/train")


class _KNNReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._set(trainPath=f"{path}/train")
        return model


class KNNModel(Model, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """The training rows are saved and loaded with the model."""

    def write(self) -> _KNNWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> _KNNReader:
        return _KNNReader(cls)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", k=KNN_K, numClasses=None, blockRows=4096, trainRows=None,
                 trainPath=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def neighbours(self, df: DataFrame) -> DataFrame:
        """``(qid, rank, tid, dist, y)``: the k nearest training rows of every distinct scored vector.

        ``qid`` is a hash of the feature vector, so equal vectors are scored once.
        """
        spark = df.sparkSession
        k, rows = self.getOrDefault(self.k), self.getOrDefault(self.blockRows)
        train = spark.read.parquet(self.getOrDefault(self.trainPath))
        x = _features_array(df, self.getFeaturesCol())
        test = df.select(F.xxhash64(x).alias("qid"), x.alias("x")).dropDuplicates(["qid"])
        A = max(1, math.ceil(test.count() / rows))
        B = max(1, math.ceil(self.getOrDefault(self.trainRows) / rows))
        test_rep = test.withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(A))).withColumn(
            "b", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
        train_rep = train.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(B))).drop("row").withColumn(
            "a", F.explode(F.sequence(F.lit(0), F.lit(A - 1))))
        local = test_rep.groupBy("a", "b").cogroup(train_rep.groupBy("a", "b")).applyInPandas(
            _block_topk(k), "qid long, tid long, dist double, y int")
        w = Window.partitionBy("qid").orderBy("dist", "tid")
        return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _transform(self, df: DataFrame) -> DataFrame:
        n_cls = self.getOrDefault(self.numClasses)
        keyed = df.withColumn("__qid", F.xxhash64(_features_array(df, self.getFeaturesCol())))
        nb = self.neighbours(df)
        votes = nb.groupBy("qid").agg(*[F.count_if(F.col("y") == c).alias(f"v{c}") for c in range(n_cls)],
                                      F.count(F.lit(1)).alias("_n"))
        vs = [F.col(f"v{c}") for c in range(n_cls)]
        scored = votes.select(F.col("qid").alias("__qid"), _argmax_expr(vs).alias(self.getPredictionCol()),
                              array_to_vector(F.array(*[v / F.col("_n") for v in vs])).alias(self.getProbabilityCol()))
        return keyed.join(scored, "__qid", "left").drop("__qid")


# ---------------------------------------------------------------- random Fourier features

class RandomFourierFeatures(Transformer, HasFeaturesCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi): approximates exp(-gamma ||x - y||^2)."""

    outputCol = Param(Params._dummy(), "outputCol", "output vector column", typeConverter=TypeConverters.toString)
    numComponents = Param(Params._dummy(), "numComponents", "D", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "input dimension", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", outputCol="rff", numComponents=200, gamma=1.0, numFeatures=None,
                 seed=42):
        super().__init__()
        self._setDefault(numComponents=200, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        D, p = self.getOrDefault(self.numComponents), self.getOrDefault(self.numFeatures)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        W = rng.normal(0.0, math.sqrt(2 * self.getOrDefault(self.gamma)), size=(p, D))
        b = rng.uniform(0, 2 * math.pi, size=D)
        scale = math.sqrt(2.0 / D)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            m = np.stack(xs.to_numpy()).astype(np.float64)
            z = scale * np.cos(m @ W + b)
            return pd.Series(list(z))

        arr = _features_array(df, self.getFeaturesCol())
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(arr)))


def rbf_gamma_scale(df: DataFrame, features_col: str) -> tuple[float, int]:
    """gamma = 1 / (n_features * variance of all feature values) ('scale' rule); one agg."""
    x = _features_array(df, features_col)
    p = len(df.select(x.alias("x")).first()["x"])
    v = df.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    return 1.0 / (p * v if v > 0 else p), p
