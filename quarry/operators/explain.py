"""Explaining trained pipelines.

* native importance of tree learners and coefficients of linear learners,
  named by the assembler's slot metadata;
* permutation importance: every (feature, repeat) variant of the scored rows
  is built at once -- the donor row for a position comes from a seeded hash
  rank computed with distributed prefix counts -- then scored with one
  ``transform`` and one grouped metric;
* sampling Shapley values (Strumbelj & Kononenko, 2014): for each explained
  row and permutation, hybrids taking the first k features (in permutation
  order) from the row and the rest from a background row; consecutive
  differences are the contributions, which sum to f(x) minus the mean
  background prediction. Exact ``w * (x - mean)`` for linear learners and
  exact path-dependent values for forests and trees (``tree_shap``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.frames import field_types, q
from quarry.functions.ranks import prefix_counts
from quarry.operators.forest import ForestModel
from quarry.operators.prepare import SEED
from quarry.operators.tree_shap import tree_shap
from quarry.session import checkpoint_root

# How many features are shown and how many rows / draws explanations use.
TOP_FEATURES = 10
PERMUTATION_REPEATS = 10
SHAP_ROWS = 100
SHAP_PERMUTATIONS = 10
SHAP_BACKGROUND = 100


def slot_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled vector slots from the ML attribute metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs += group
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]


def learner_stage(model: PipelineModel):
    return [s for s in model.stages if not isinstance(s, IndexToString)][-1]


def _normalised(spark, names: Sequence[str], values: Sequence[float], signed_order: bool = False) -> DataFrame:
    total = sum(abs(v) for v in values) or 1.0
    rows = [(n, round(float(v) / total, 4)) for n, v in zip(names, values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    order = F.col("importance").desc() if signed_order else F.abs("importance").desc()
    # one row per feature: a small table
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col("feature")))).where(
        F.col("rank") <= TOP_FEATURES)


def tree_importance(model: PipelineModel, names: Sequence[str]) -> DataFrame | None:
    """Native tree importance / sum of abs, top 10 by abs (4 dp); empty on length mismatch; None if not a tree."""
    stage = learner_stage(model)
    if not hasattr(stage, "featureImportances"):
        return None
    imp = stage.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    if len(imp) != len(names):
        return spark.createDataFrame([], "feature string, importance double, rank int")
    return _normalised(spark, names, imp)


def linear_importance(model: PipelineModel, names: Sequence[str], absolute: bool = True) -> DataFrame | None:
    """Coefficients (first class row when multinomial), abs or signed, normalised the same way."""
    stage = learner_stage(model)
    spark = SparkSession.getActiveSession()
    if hasattr(stage, "coefficientMatrix") and stage.coefficientMatrix.numRows > 1:
        coef = stage.coefficientMatrix.toArray()[0].tolist()
    elif hasattr(stage, "coefficients"):
        coef = stage.coefficients.toArray().tolist()
    else:
        return None
    if len(coef) != len(names):
        return spark.createDataFrame([], "feature string, importance double, rank int")
    return _normalised(spark, names, [abs(c) if absolute else c for c in coef])


def _score_expr(problem_type: str, label: str, pred: str):
    if problem_type == "classification":
        return F.avg(F.when(q(label).cast("string") == F.col(pred).cast("string"), 1.0).otherwise(0.0))
    y, p = q(label).cast("double"), F.col(pred).cast("double")
    return 1 - F.sum((y - p) ** 2) / (F.var_pop(y) * F.count(y))


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, target: str, problem_type: str,
                           features: Sequence[str], repeats: int = PERMUTATION_REPEATS, seed: int = SEED) -> DataFrame:
    """Mean score drop when one input column is shuffled, over ``repeats`` shuffles; / sum of abs; top 10 by value."""
    spark = df.sparkSession
    pred = "predicted_label" if problem_type == "classification" else "prediction"
    checkpoint_root(spark)
    # rows of one key are told apart by a row number of the stored table
    base_rows = df.select(q(key), q(target), *[q(c) for c in features if c != key]).withColumn(
        "_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    # position of each row: rank of its key, then row (distributed prefix counts, one group)
    pos = prefix_counts(base_rows.select(F.struct(q(key), "_id").alias("_k"), F.lit(1).alias("cnt"), F.lit(0).alias("_g")),
                        ["_g"], "_k", "cnt").select(F.col("_k._id").alias("_id"), F.col("before").alias("_pos"))
    base = base_rows.join(pos, "_id").drop("_id")
    # donors: for each (feature, repeat), rows re-ranked by a seeded hash of the key
    cells = [F.struct(F.lit(c).alias("_f"), q(c).cast("string").alias("_v")) for c in features]
    donor_src = base.select("_pos", q(key).alias("_key"), F.inline(F.array(*cells))).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    # the position makes equal hashes (repeated keys) distinct: every slot gets one donor
    donor_src = donor_src.withColumn("_h", F.struct(F.xxhash64(F.lit(seed), "_key", "_f", "_r").alias("h"), "_pos"))
    donors = prefix_counts(donor_src.withColumn("cnt", F.lit(1)), ["_f", "_r"], "_h", "cnt").select(
        "_f", "_r", F.col("before").alias("_slot"), "_v")
    variants = base.join(donors, base["_pos"] == donors["_slot"]).drop("_slot")
    types = field_types(base)
    variants = variants.withColumns({c: F.when(F.col("_f") == c, F.col("_v").cast(types[c])).otherwise(q(c))
                                     for c in features})
    baseline = model.transform(base).agg(_score_expr(problem_type, target, pred).alias("s")).first()["s"]
    scored = model.transform(variants).groupBy("_f", "_r").agg(_score_expr(problem_type, target, pred).alias("s"))
    drops = scored.groupBy("_f").agg((F.lit(baseline) - F.avg("s")).alias("drop")).collect()
    by = {r["_f"]: r["drop"] for r in drops}
    return _normalised(spark, list(features), [by.get(c, 0.0) for c in features], signed_order=True)


def _model_output(model: PipelineModel, df: DataFrame, problem_type: str, class_index: int = 1):
    out = model.transform(df)
    if problem_type == "classification" and "probability" in out.columns:
        return out.withColumn("_out", vector_to_array("probability")[class_index])
    return out.withColumn("_out", F.col("prediction").cast("double"))


def shapley_values(model: PipelineModel, df: DataFrame, background: DataFrame, key: str, features: Sequence[str],
                   problem_type: str, rows: int = SHAP_ROWS, permutations: int = SHAP_PERMUTATIONS,
                   background_rows: int = SHAP_BACKGROUND, seed: int = SEED, class_index: int = 1) -> DataFrame:
    """``(key, feature, contribution, base)`` by permutation-sampling Shapley over input columns.

    Explains the ``rows`` rows with the smallest seeded key hash (sampling is
    the feature); the background is the ``background_rows`` smallest-hash rows
    of ``background`` (both bounded, the background is broadcast).
    """
    feats = [c for c in features if c != key]
    p = len(feats)
    pick = df.withColumn("_h", F.xxhash64(F.lit(seed), q(key))).orderBy("_h").limit(rows).drop("_h")
    bg = (background.select(*[q(c) for c in feats]).withColumn("_bh", F.xxhash64(F.lit(seed + 1), *[q(c) for c in feats]))
          .orderBy("_bh").limit(background_rows).withColumn("_bi", F.row_number().over(Window.orderBy("_bh")) - 1)
          .drop("_bh"))
    n_bg = max(1, min(background_rows, background.limit(background_rows).count()))
    draws = pick.select(q(key).alias("_key"), *[q(c) for c in feats]).withColumn(
        "_m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    draws = draws.withColumn("_bi", F.pmod(F.xxhash64(F.lit(seed), "_key", "_m"), F.lit(n_bg)))
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col("_key"), F.col("_m"), F.lit(i)).alias("h"),
                                            F.lit(i).alias("i")) for i in range(p)]))
    draws = draws.withColumn("_order", F.transform(order, lambda s: s["i"]))
    bgz = bg.select("_bi", *[q(c).alias(f"_z_{i}") for i, c in enumerate(feats)])
    j = draws.join(F.broadcast(bgz), "_bi").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(p))))
    rank = {i: F.array_position(F.col("_order"), F.lit(i)) - 1 for i in range(p)}
    hybrid = j.select("_key", "_m", "_k", "_order",
                      *[F.when(rank[i] < F.col("_k"), q(c)).otherwise(F.col(f"_z_{i}")).alias(c) for i, c in enumerate(feats)])
    out = _model_output(model, hybrid, problem_type, class_index).select("_key", "_m", "_k", "_order", "_out")
    w = Window.partitionBy("_key", "_m").orderBy("_k")
    steps = out.withColumn("_prev", F.lag("_out").over(w)).where(F.col("_k") > 0)
    steps = steps.withColumn("_fi", F.element_at(F.col("_order"), F.col("_k")))
    contrib = steps.groupBy("_key", "_fi").agg((F.sum(F.col("_out") - F.col("_prev")) / permutations).alias("contribution"))
    base = out.where(F.col("_k") == 0).groupBy("_key").agg(F.avg("_out").alias("base"))
    names = df.sparkSession.createDataFrame(list(enumerate(feats)), "_fi int, feature string")
    return contrib.join(F.broadcast(names), "_fi").join(base, "_key").select(
        F.col("_key").alias(key), "feature", "contribution", "base")


def linear_shap(model: PipelineModel, df: DataFrame, background: DataFrame, key: str,
                features_col: str = "features") -> DataFrame:
    """Exact contributions ``w_j * (x_j - mean_j)`` of a linear learner over the assembled slots, with their base.

    The base is the linear output at the background's mean (a margin for classifiers).
    """
    from quarry.operators.score import preprocessing_stages

    stage = learner_stage(model)
    coef = (stage.coefficientMatrix.toArray()[0] if hasattr(stage, "coefficientMatrix")
            and stage.coefficientMatrix.numRows > 1 else stage.coefficients.toArray()).tolist()
    pre = preprocessing_stages(model)
    x = pre.transform(df)
    names = slot_names(x, features_col)
    bg = pre.transform(background).select(vector_to_array(features_col).alias("v"))
    means = bg.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(coef))]).first()
    arr = vector_to_array(features_col)
    cells = [F.struct(F.lit(names[i] if i < len(names) else f"f{i}").alias("feature"),
                      (F.lit(coef[i]) * (arr[i] - F.lit(means[f"m{i}"] or 0.0))).alias("contribution"))
             for i in range(len(coef))]
    many = hasattr(stage, "coefficientMatrix") and stage.coefficientMatrix.numRows > 1
    at_zero = float(stage.interceptVector[0] if many else stage.intercept)
    base = at_zero + sum(c * (means[f"m{i}"] or 0.0) for i, c in enumerate(coef))
    return x.select(q(key), F.inline(F.array(*cells)), F.lit(base).alias("base"))


def shap_values(model: PipelineModel, df: DataFrame, background: DataFrame, key: str, features: Sequence[str],
                problem_type: str, rows: int = SHAP_ROWS, seed: int = SEED) -> DataFrame:
    """``(key, feature, contribution, base)`` of the ``rows`` rows of smallest seeded key hash, by the learner's own form.

    Forests and single trees: exact, per feature slot. Linear learners: exact,
    per slot. Others: sampled Shapley values per input column.
    """
    from quarry.operators.score import preprocessing_stages

    stage = learner_stage(model)
    pick = df.withColumn("_h", F.xxhash64(F.lit(seed), q(key))).orderBy("_h").limit(rows).drop("_h")
    if isinstance(stage, ForestModel):
        x = preprocessing_stages(model).transform(pick)
        return tree_shap(stage, x, key, slot_names(x))
    if hasattr(stage, "coefficients") or hasattr(stage, "coefficientMatrix"):
        if stage.numFeatures == len(slot_names(preprocessing_stages(model).transform(pick))):
            return linear_shap(model, pick, background, key)
    return shapley_values(model, df, background, key, features, problem_type, rows, seed=seed)


def explain_prediction(shap: DataFrame, key: str, value, k: int = TOP_FEATURES) -> DataFrame:
    """Top ``k`` contributions of one row by absolute size; nothing when the key is unknown."""
    one = shap.where(q(key) == F.lit(value))
    # one row per feature of one explained row: small
    w = Window.orderBy(F.abs("contribution").desc(), F.col("feature"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def feature_ranking(importance: DataFrame) -> DataFrame:
    """``(Rank, Feature, Importance)`` ordered by absolute importance; keeps its columns when empty."""
    # one row per feature: small
    w = Window.orderBy(F.abs("importance").desc(), F.col("feature"))
    return importance.select(F.row_number().over(w).alias("Rank"), F.col("feature").alias("Feature"),
                             F.col("importance").alias("Importance"))


def shap_summary(shap: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature (the data behind a summary plot)."""
    return shap.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def explain_model(model: PipelineModel, test: DataFrame, train: DataFrame, key: str, target: str | None,
                  problem_type: str, features: Sequence[str], with_shap: bool = True) -> dict:
    """Tree importance -> linear coefficients -> permutation importance (needs a target) -> unsupported;
    Shapley values alongside."""
    from quarry.operators.score import preprocessing_stages

    names = slot_names(preprocessing_stages(model).transform(test.limit(1)))
    out: dict = {"method": "unsupported", "importance": None, "shap": None}
    imp = tree_importance(model, names)
    if imp is not None:
        out.update(method="tree", importance=imp)
    else:
        imp = linear_importance(model, names)
        if imp is not None:
            out.update(method="linear", importance=imp)
        elif target is not None:
            out.update(method="permutation",
                       importance=permutation_importance(model, test, key, target, problem_type, features))
    if with_shap:
        out["shap"] = shap_values(model, test, train, key, features, problem_type)
    return out
