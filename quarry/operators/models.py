"""Model training and selection with ``pyspark.ml``.

A candidate is a list of stages placed after the fitted preprocessor; the
full ``Pipeline`` is preprocessor + label indexer (classification) + model +
label decoder, so one ``PipelineModel`` scores raw rows end to end. Cross
validation uses hash folds of a key (deterministic, no shuffle).

Comparing models works on a ``TrainingStore``: the preprocessor is fitted once
per fold (and once on all training rows), and the assembled features of every
fold are stored once; all learners and all settings of a search read them.
Forests, single trees and boosted stumps grow all folds and settings in the
same jobs; the other learners fit fold by fold from several driver threads.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.frames import q
from quarry.functions.ranks import prefix_counts
from quarry.operators.forest import (
    ForestClassifier, ForestEstimator, ForestRegressor, cross_values, stored_rows, target_steps,
)
from quarry.operators.learners import (
    GaussianNB, KNNClassifier, RandomFourierFeatures, _features_array, rbf_gamma_scale,
)
from quarry.operators.metrics import evaluate
from quarry.operators.prepare import SEED, PreparedData, hash_bucket
from quarry.operators.stumps import AdaBoostClassifier, boost
from quarry.session import ROWS_PER_TASK, checkpoint_root, stored

# Training defaults of the reference (library defaults) and the tuning grids.
CV_FOLDS = 5
PRIMARY = {"classification": "accuracy", "regression": "r2"}
CLASS_WEIGHT_CAPABLE = {"Logistic Regression", "Random Forest", "Extra Trees", "Decision Tree", "SVM"}
NO_LIMIT = 0  # of tree depth
PARAM_GRIDS = {
    "Random Forest": {"numTrees": [100, 200, 300], "maxDepth": [NO_LIMIT, 8, 16, 24],
                      "minInstancesPerNode": [1, 2, 5]},
    "Extra Trees": {"numTrees": [100, 200, 300], "maxDepth": [NO_LIMIT, 8, 16, 24],
                    "minInstancesPerNode": [1, 2, 5]},
    "Gradient Boosting": {"maxIter": [100, 200], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [2, 3, 4]},
    "Decision Tree": {"maxDepth": [NO_LIMIT, 5, 10, 20], "minInstancesPerNode": [1, 2, 5]},
}
# Named size profiles: "reference" mirrors the library defaults; "fast" keeps every
# learner but shrinks ensembles and iteration counts (used by examples and the bench).
PROFILES = {
    "reference": {"trees": 100, "depth": NO_LIMIT, "boost_iter": 100, "ada_rounds": 50, "lr_iter": 1000,
                  "rff": 300},
    "fast": {"trees": 20, "depth": 8, "boost_iter": 20, "ada_rounds": 10, "lr_iter": 100, "rff": 100},
}

FEATURES, LABEL_IDX, RAW_PRED, PRED_LABEL = "features", "label_idx", "prediction", "predicted_label"


@dataclass
class Candidate:
    name: str
    stages: Callable[[DataFrame], list]  # builds model stages from the training data
    tunable: Sequence[str] = ()


def _weight_col(class_weight: bool, name: str) -> dict:
    return {"weightCol": "class_weight"} if class_weight and name in CLASS_WEIGHT_CAPABLE else {}


def candidate_models(problem_type: str, n_train: int | None = None, class_weight: bool = False,
                     profile: str = "reference", n_classes: int = 2) -> dict[str, Candidate]:
    """Candidate learners per problem type: 9 classifiers, 6 regressors, 1 clusterer."""
    p = PROFILES[profile]
    lc, fc = LABEL_IDX, FEATURES
    if problem_type == "classification":
        def lr(d):
            n = n_train or d.count()
            return [LogisticRegression(featuresCol=fc, labelCol=lc, maxIter=p["lr_iter"], regParam=1.0 / max(n, 1),
                                       elasticNetParam=0.0, standardization=False,
                                       **_weight_col(class_weight, "Logistic Regression"))]

        def gbt(d):
            base = GBTClassifier(featuresCol=fc, labelCol=lc, maxIter=p["boost_iter"], maxDepth=3, stepSize=0.1, seed=SEED)
            return [base] if n_classes <= 2 else [OneVsRest(classifier=base, featuresCol=fc, labelCol=lc)]

        def svm(d):
            gamma, dim = rbf_gamma_scale(d, fc)
            weight = _weight_col(class_weight, "SVM")
            svc = LinearSVC(featuresCol="rff", labelCol=lc, maxIter=100, regParam=1.0 / max(d.count(), 1), **weight)
            model = svc if n_classes <= 2 else OneVsRest(classifier=svc, featuresCol="rff", labelCol=lc, **weight)
            return [RandomFourierFeatures(featuresCol=fc, outputCol="rff", numComponents=p["rff"], gamma=gamma,
                                          numFeatures=dim, seed=SEED), model]

        def trees(name, kind):
            return Candidate(name, lambda d: [ForestClassifier(
                featuresCol=fc, labelCol=lc, kind=kind, numTrees=p["trees"], maxDepth=p["depth"], seed=SEED,
                **_weight_col(class_weight, name))], tuple(PARAM_GRIDS[name]))

        return {
            "Logistic Regression": Candidate("Logistic Regression", lr),
            "Random Forest": trees("Random Forest", "forest"),
            "Extra Trees": trees("Extra Trees", "extra"),
            "Gradient Boosting": Candidate("Gradient Boosting", gbt, ("maxIter", "stepSize", "maxDepth")),
            "AdaBoost": Candidate("AdaBoost", lambda d: [AdaBoostClassifier(featuresCol=fc, labelCol=lc,
                                                                           numRounds=p["ada_rounds"], seed=SEED)]),
            "Decision Tree": trees("Decision Tree", "tree"),
            "KNN": Candidate("KNN", lambda d: [KNNClassifier(featuresCol=fc, labelCol=lc, k=5)]),
            "SVM": Candidate("SVM", svm),
            "Naive Bayes": Candidate("Naive Bayes", lambda d: [GaussianNB(featuresCol=fc, labelCol=lc)]),
        }
    if problem_type == "regression":
        lab = "label_value"

        def svr(d):
            gamma, dim = rbf_gamma_scale(d, fc)
            return [RandomFourierFeatures(featuresCol=fc, outputCol="rff", numComponents=p["rff"], gamma=gamma,
                                          numFeatures=dim, seed=SEED),
                    LinearRegression(featuresCol="rff", labelCol=lab, loss="huber", maxIter=100, regParam=1e-4)]

        def trees(name, kind):
            return Candidate(name, lambda d: [ForestRegressor(
                featuresCol=fc, labelCol=lab, kind=kind, numTrees=p["trees"], maxDepth=p["depth"], seed=SEED)],
                tuple(PARAM_GRIDS[name]))

        return {
            "Linear Regression": Candidate("Linear Regression", lambda d: [LinearRegression(
                featuresCol=fc, labelCol=lab, regParam=0.0, solver="normal")]),
            "Random Forest": trees("Random Forest", "forest"),
            "Extra Trees": trees("Extra Trees", "extra"),
            "Gradient Boosting": Candidate("Gradient Boosting", lambda d: [GBTRegressor(
                featuresCol=fc, labelCol=lab, maxIter=p["boost_iter"], maxDepth=3, stepSize=0.1, seed=SEED)],
                ("maxIter", "stepSize", "maxDepth")),
            "Decision Tree": trees("Decision Tree", "tree"),
            "SVR": Candidate("SVR", svr),
        }
    if problem_type == "clustering":
        return {"KMeans": Candidate("KMeans", lambda d: [KMeans(featuresCol=fc, k=3, seed=SEED)])}
    raise ValueError(f"Unsupported problem type: {problem_type}")


def balanced_class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Weight n / (k * n_class) per row; the per-class table (k rows) is broadcast."""
    counts = df.groupBy(q(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").select(
        "_cls", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), df[f"`{label}`"].eqNullSafe(w["_cls"]), "left").drop("_cls")


def label_indexer(train: DataFrame, target: str):
    """Class labels (sorted as text) learned on the training split; index column ``label_idx``."""
    return StringIndexer(inputCol=target, outputCol=LABEL_IDX, stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(train.where(q(target).isNotNull()))


def build_pipeline(prep: PreparedData | None, model_stages: list, problem_type: str, labels: Sequence[str] | None = None,
                   preprocessor: Pipeline | None = None) -> Pipeline:
    """Preprocessor + model stages (+ ``IndexToString`` decoding predictions to the original labels)."""
    stages = list((preprocessor or (prep.preprocessor if prep else Pipeline(stages=[]))).getStages())
    stages += model_stages
    if problem_type == "classification" and labels is not None:
        stages.append(IndexToString(inputCol=RAW_PRED, outputCol=PRED_LABEL, labels=list(labels)))
    return Pipeline(stages=stages)


def _label_prep(df: DataFrame, problem_type: str, target: str, indexer=None) -> DataFrame:
    if problem_type == "regression":
        return df.withColumn("label_value", q(target).cast("double"))
    out = df.withColumn(target, q(target).cast("string"))
    if indexer is None:
        return out
    # rows whose label was never seen in training get no index (they still score)
    known = F.array(*[F.lit(v) for v in indexer.labels])
    idx = F.array_position(known, q(target)) - 1
    return out.withColumn(LABEL_IDX, F.when(idx >= 0, idx.cast("double")))


def _scores(scored: DataFrame, problem_type: str, target: str) -> dict:
    if problem_type == "classification":
        m = evaluate(scored, "classification", label=target, prediction=PRED_LABEL)
    else:
        m = evaluate(scored, "regression", label="label_value", prediction=RAW_PRED)
    return m.first().asDict()


def fold_column(df: DataFrame, key: str, k: int, seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """Add ``_fold`` in 0..k-1: a hash of the key, or with ``stratify`` each class dealt out in hash order.

    Dealing keeps the class shares of all folds within one key of each other;
    rows of one key and class share a fold. Ranks come from the distributed prefix
    counts, so a class holding most rows is spread over many tasks.
    """
    bucket = hash_bucket(q(key), seed, salt=":fold")
    if stratify is None:
        return df.withColumn("_fold", (bucket % k).cast("int"))
    keyed = df.withColumns({"_cls": F.coalesce(q(stratify).cast("string"), F.lit("\u0000null")),
                            "_ord": F.struct(bucket.alias("b"), q(key).alias("k"))})
    units = keyed.select("_cls", "_ord").distinct().withColumn("cnt", F.lit(1))
    ranked = prefix_counts(units, ["_cls"], "_ord", "cnt").select(
        F.col("_cls").alias("_c"), F.col("_ord").alias("_o"), (F.col("before") % k).cast("int").alias("_fold"))
    return keyed.join(ranked, (F.col("_cls") == F.col("_c")) & F.col("_ord").eqNullSafe(F.col("_o"))).drop(
        "_cls", "_ord", "_c", "_o")


class TrainingStore:
    """Everything the learners of one comparison read, prepared once.

    ``train`` and ``test`` hold the assembled features of the training and test
    rows (preprocessor fitted on all training rows); ``folds(k)`` those of the
    training rows once per fold, with a preprocessor fitted on the other folds.
    All are stored in the shared folder, in as many parts as their rows ask for.
    """

    def __init__(self, prep: PreparedData, problem_type: str, class_weight: bool = False):
        self.prep, self.problem_type, self.target = prep, problem_type, prep.target
        self.classifier = problem_type == "classification"
        checkpoint_root(prep.train.sparkSession)
        indexer = label_indexer(_label_prep(prep.train, problem_type, self.target), self.target) if self.classifier else None
        self.labels = list(indexer.labels) if indexer is not None else None
        raw = _label_prep(prep.train, problem_type, self.target, indexer).where(
            F.col(LABEL_IDX).isNotNull() if self.classifier else q(self.target).isNotNull())
        if class_weight and self.classifier:
            raw = balanced_class_weights(raw, self.target)
        self.n = raw.count()
        self.parts = max(1, math.ceil(self.n / ROWS_PER_TASK))
        self.raw = stored(raw.coalesce(self.parts), self.parts)
        self.preprocessor = prep.preprocessor.fit(self.raw)
        self.train = self.preprocessor.transform(self.raw).checkpoint(eager=True)
        self.test = self.preprocessor.transform(_label_prep(prep.test, problem_type, self.target, indexer)).coalesce(
            self.parts).checkpoint(eager=True)
        self.label = LABEL_IDX if self.classifier else "label_value"
        self.n_features = len((self.train.select(FEATURES).first() or {FEATURES: []})[FEATURES])
        self._folds: dict[int, list[DataFrame]] = {}

    def folds(self, k: int) -> list[DataFrame]:
        """Per fold ``store`` (its number), ``held``, features, label and weight; none below two rows."""
        if k not in self._folds:
            n = min(k, self.n)
            if n < 2:
                return []
            data = stored(fold_column(self.raw, self.prep.key, n, stratify=self.target if self.classifier else None).coalesce(
                self.parts), self.parts)

            def one(i: int) -> DataFrame:
                pre = self.prep.preprocessor.fit(data.where(F.col("_fold") != i))
                weight = [F.col("class_weight")] if "class_weight" in data.columns else []
                return pre.transform(data).select(F.lit(i).alias("store"), (F.col("_fold") == i).alias("held"), FEATURES,
                                                  F.col(self.label).cast("double").alias(self.label), *weight).checkpoint(eager=True)
            with ThreadPoolExecutor(max_workers=n) as pool:
                self._folds[k] = list(pool.map(one, range(n)))
        return self._folds[k]

    def scores(self, predicted: DataFrame) -> dict[int, float]:
        """Accuracy (fraction) or r2 per ``store`` of ``predicted (store, y, prediction)``."""
        y, p = F.col("y"), F.col("prediction")
        score = F.avg((y == p).cast("double")) if self.classifier else F.when(
            F.var_pop("y") > 0, 1 - F.sum((y - p) ** 2) / (F.var_pop("y") * F.count("y")))
        rows = predicted.groupBy("store").agg(score.alias("score")).orderBy("store").collect()
        return {r["store"]: r["score"] for r in rows if r["score"] is not None}

    def tree_rows(self, folds: Sequence[DataFrame]) -> DataFrame:
        """The folds as rows of the forest engine, features padded to one length."""
        folds = _together(folds)
        x = _features_array(folds, FEATURES)
        long = folds.agg(F.max(F.size(x))).first()[0] or 0
        x = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(long) - F.size(x)))
        weight = F.col("class_weight") if "class_weight" in folds.columns else F.lit(1.0)
        return stored_rows(folds.select(
            F.monotonically_increasing_id().alias("rid"), "store", "held",
            F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(v)).alias("x"),
            F.col(self.label).alias("y"), weight.cast("double").alias("w")))


def _summary(scores: Sequence[float]) -> dict:
    if not scores:
        return {"mean": None, "std": None}
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {"mean": round(mean, 4), "std": round(std, 4)}


def cross_validate(store: TrainingStore, cand: Candidate, settings: Sequence[dict] = ({},), k: int = CV_FOLDS) -> list[dict]:
    """k-fold CV of every setting: mean and population std of accuracy (fraction) or r2; None below 2 rows."""
    folds = store.folds(k)
    if not folds:
        return [{"mean": None, "std": None} for _ in settings]
    stages = []
    for params in settings:
        stages.append(cand.stages(store.train))
        _set_params(stages[-1][-1], params)
    kinds = {type(s[-1]) for s in stages}
    if all(issubclass(c, ForestEstimator) for c in kinds):
        scores = _tree_scores(store, folds, [s[-1] for s in stages])
    elif kinds == {AdaBoostClassifier}:
        scores = [_stump_scores(store, folds, s[-1]) for s in stages]
    else:
        scores = [_fit_scores(store, folds, cand, params) for params in settings]
    return [_summary(s) for s in scores]


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fit_scores(store: TrainingStore, folds: Sequence[DataFrame], cand: Candidate, params: dict) -> list[float]:
    """One fit per fold, several at a time."""
    def one(fold: DataFrame) -> DataFrame:
        train = fold.where(~F.col("held"))
        stages = cand.stages(train)
        _set_params(stages[-1], params)
        model = Pipeline(stages=stages).fit(train)
        return model.transform(fold.where("held")).select(
            "store", F.col(store.label).alias("y"), F.col(RAW_PRED).alias("prediction"))
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        return list(store.scores(_together(list(pool.map(one, folds)))).values())


def _tree_scores(store: TrainingStore, folds: Sequence[DataFrame], stages: Sequence[ForestEstimator]) -> list[list[float]]:
    """All folds of all settings grow together."""
    n = len(folds)
    rows = store.tree_rows(folds)
    seen = rows.agg(F.max("y").alias("k"), F.min("y").alias("least"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("p")).first()
    classes = int(seen["k"]) + 1 if store.classifier else 0
    target = (0.0, 1.0) if classes else target_steps(seen["least"], seen["mean"], seen["k"])
    growers = [s.grower(seen["p"], classes, *target, i) for s in stages for i in range(n)]
    values = cross_values(rows, growers)
    v = F.col("value")
    prediction = (F.array_position(v, F.array_max(v)) - 1).cast("double") if classes else v[0]
    predicted = values.select(F.col("job").alias("store"), "y", prediction.alias("prediction"))
    per = store.scores(predicted)
    return [[per[j * n + i] for i in range(n) if j * n + i in per] for j in range(len(stages))]


def _stump_scores(store: TrainingStore, folds: Sequence[DataFrame], stage: AdaBoostClassifier) -> list[float]:
    """All folds are boosted together."""
    rows = store.tree_rows(folds)
    classes = {r["store"]: int(r["k"]) + 1 for r in rows.where("not held").groupBy("store").agg(F.max("y").alias("k")).collect()}
    fitted = boost(rows, classes, stage.getOrDefault(stage.numRounds))
    parts = [stage.fitted(*fitted[i], classes[i]).transform(folds[i].where("held")).select(
        "store", F.col(store.label).alias("y"), F.col(RAW_PRED).alias("prediction")) for i in sorted(fitted)]
    return list(store.scores(_together(parts)).values())


def random_search(store: TrainingStore, cand: Candidate, n_iter: int = 10, folds: int = 3, seed: int = SEED) -> dict:
    """Seeded sample of ``n_iter`` settings from the candidate's grid, scored by ``folds``-fold CV."""
    grid = PARAM_GRIDS.get(cand.name)
    if not grid:
        return {}
    names = list(grid)
    combos = [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]
    picked = random.Random(seed).sample(combos, min(n_iter, len(combos)))
    scored = [(s["mean"], -i) for i, s in enumerate(cross_validate(store, cand, picked, folds)) if s["mean"] is not None]
    return picked[-max(scored)[1]] if scored else {}


def _set_params(stage, params: dict) -> None:
    target = stage.getClassifier() if isinstance(stage, OneVsRest) else stage
    for name, value in params.items():
        if target.hasParam(name):
            target._set(**{name: value})


@dataclass
class TrainResult:
    name: str
    model: PipelineModel | None
    metrics: dict
    cv_mean: float | None
    cv_std: float | None
    train_time_sec: float
    predict_time_sec: float
    feature_count: int
    params: dict = field(default_factory=dict)
    error: str | None = None


def _param_map(stage) -> dict:
    out = {}
    for p, v in stage.extractParamMap().items():
        if isinstance(v, (int, float, str, bool)):
            out[p.name] = v
    return out


def train_one(prep: PreparedData, cand: Candidate, problem_type: str, cv: int = CV_FOLDS, tune: bool = False,
              class_weight: bool = False, store: TrainingStore | None = None) -> TrainResult:
    """tune? -> CV -> fit -> predict -> evaluate, timed; any failure -> result with ``error`` set."""
    try:
        store = store or TrainingStore(prep, problem_type, class_weight)
        tuned = random_search(store, cand) if tune else {}
        cv_res = cross_validate(store, cand, [tuned], cv)[0] if cv else {"mean": None, "std": None}
        t0 = time.perf_counter()
        stages = cand.stages(store.train)
        _set_params(stages[-1], tuned)
        fitted = build_pipeline(None, stages, problem_type, store.labels).fit(store.train)
        fit_s = time.perf_counter() - t0
        t1 = time.perf_counter()
        scored = fitted.transform(store.test).cache()
        scored.count()  # force the predict job before stopping the clock
        pred_s = time.perf_counter() - t1
        metrics = _scores(scored, problem_type, store.target)
        scored.unpersist()
        model = PipelineModel(stages=[*store.preprocessor.stages, *fitted.stages])
        learner = [st for st in fitted.stages if not isinstance(st, IndexToString)][-1]
        return TrainResult(cand.name, model, metrics, cv_res["mean"], cv_res["std"], round(fit_s, 4), round(pred_s, 4),
                           store.n_features, _param_map(learner) | tuned)
    except Exception as e:  # noqa: BLE001 - one failing learner must not stop the run
        return TrainResult(cand.name, None, {}, None, None, 0.0, 0.0, 0, {}, error=f"{type(e).__name__}: {e}")


def train_all(prep: PreparedData, cv: int = CV_FOLDS, tune: bool = False, class_weight: bool = False,
              profile: str = "reference", only: Sequence[str] | None = None, parallelism: int = 1,
              progress: Callable[[int, int, str], None] | None = None) -> list[TrainResult]:
    """Every candidate of the problem type; failed ones come last, with their ``error``; error if all fail."""
    n_classes = 2
    if prep.problem_type == "classification":
        n_classes = prep.train.select(q(prep.target)).distinct().count()
    cands = candidate_models(prep.problem_type, class_weight=class_weight, profile=profile, n_classes=n_classes)
    if only:
        cands = {k: v for k, v in cands.items() if k in only}
    items = list(cands.values())
    store = TrainingStore(prep, prep.problem_type, class_weight)
    if cv:
        store.folds(cv)

    def run(i_c):
        i, c = i_c
        if progress:
            progress(i + 1, len(items), c.name)
        return train_one(prep, c, prep.problem_type, cv, tune, class_weight, store)

    if parallelism > 1:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            results = list(pool.map(run, enumerate(items)))
    else:
        results = [run(x) for x in enumerate(items)]
    ok = [r for r in results if r.error is None]
    if not ok:
        raise RuntimeError(f"All candidate models failed: {[(r.name, r.error) for r in results]}")
    return ok + [r for r in results if r.error is not None]


LEADERBOARD_SCHEMA_C = ("model string, accuracy double, precision double, recall double, f1 double, cv_mean double, "
                        "cv_std double, train_time_sec double, predict_time_sec double, feature_count int, error string")
LEADERBOARD_SCHEMA_R = ("model string, mae double, mse double, rmse double, r2 double, explained_variance double, "
                        "median_absolute_error double, mape double, cv_mean double, cv_std double, "
                        "train_time_sec double, predict_time_sec double, feature_count int, error string")


def results_table(spark, results: Sequence[TrainResult], problem_type: str) -> DataFrame:
    if problem_type == "classification":
        keys, schema = ["accuracy", "precision", "recall", "f1"], LEADERBOARD_SCHEMA_C
    else:
        keys, schema = ["mae", "mse", "rmse", "r2", "explained_variance", "median_absolute_error", "mape"], LEADERBOARD_SCHEMA_R
    rows = [(r.name, *[r.metrics.get(k) for k in keys], r.cv_mean, r.cv_std, r.train_time_sec, r.predict_time_sec,
             r.feature_count, r.error) for r in results]
    return spark.createDataFrame(rows, schema)


def model_leaderboard(results: DataFrame, problem_type: str, metric: str | None = None) -> DataFrame:
    """Rank on the primary metric, best first (ties by model name)."""
    metric = metric or PRIMARY[problem_type]
    # one row per trained model: a small table
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col("model"))
    return results.withColumn("rank", F.row_number().over(w))


def select_best(board: DataFrame) -> DataFrame:
    return board.where(F.col("rank") == 1)


@dataclass
class Comparison:
    leaderboard: DataFrame
    results: list[TrainResult]
    best: TrainResult

    @property
    def best_model(self) -> PipelineModel:
        return self.best.model


def train_and_compare(prep: PreparedData, cv: int = CV_FOLDS, tune: bool = False, class_weight: bool = False,
                      profile: str = "reference", only: Sequence[str] | None = None, parallelism: int = 1,
                      progress=None) -> Comparison:
    results = train_all(prep, cv, tune, class_weight, profile, only, parallelism, progress)
    spark = prep.train.sparkSession
    board = model_leaderboard(results_table(spark, results, prep.problem_type), prep.problem_type)
    best_name = select_best(board).first()["model"]
    return Comparison(board, results, next(r for r in results if r.name == best_name))


def kmeans_best_of(df: DataFrame, k: int = 3, n_init: int = 10, seed: int = SEED, features_col: str = FEATURES):
    """K-means from ``n_init`` seeds on a stored input; keep the lowest training cost.

    Each fit keeps the stored vectors as objects; those of a cached table would be decoded in every iteration.
    """
    checkpoint_root(df.sparkSession)
    data = df.select(features_col).checkpoint(eager=True)
    best = None
    for i in range(n_init):
        m = KMeans(featuresCol=features_col, k=k, seed=seed + i).fit(data)
        cost = m.summary.trainingCost
        if best is None or cost < best[1]:
            best = (m, cost)
    return best[0]


def cluster_table(df: DataFrame, k: int = 3, n_init: int = 10) -> DataFrame:
    """Feature-engineer with no target, K-means on the numeric features, cluster sizes ``(cluster, size)``."""
    from quarry.operators.features import engineer_features
    from quarry.functions.frames import field_types, is_numeric

    with_dummy = df.withColumn("__dummy_target", F.lit(0))
    eng = engineer_features(with_dummy, "__dummy_target").data
    types = field_types(eng)
    nums = [c for c in eng.columns if is_numeric(types[c])]
    if not nums:
        raise ValueError("no numeric feature remains for clustering")
    vec = VectorAssembler(inputCols=nums, outputCol=FEATURES, handleInvalid="keep").transform(eng)
    model = kmeans_best_of(vec, k, n_init)
    return model.transform(vec).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def compact_leaderboard(board: DataFrame) -> DataFrame:
    """Score = first non-zero of accuracy, r2, roc_auc, f1; rank with nulls last."""
    def col(c):
        return F.col(c) if c in board.columns else F.lit(None).cast("double")
    score = F.coalesce(*[F.nullif(col(c), F.lit(0.0)) for c in ("accuracy", "r2", "roc_auc", "f1")])
    w = Window.orderBy(F.col("score").desc_nulls_last(), F.col("model"))
    # one row per model: a small table
    return board.withColumn("score", score).withColumn("rank", F.row_number().over(w))
