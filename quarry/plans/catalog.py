"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query runs a library operator over whole tables (or views Spark derives
from them); see ``checks.catalog_sql`` for the matching DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import profile as pr
from quarry.plans import fixtures
from quarry.plans.fixtures import dirty, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


VIEWS = {"dirty": dirty, "scored_binary": fixtures.scored_binary, "scored_multi": fixtures.scored_multi,
         "scored_regression": fixtures.scored_regression, "scored_proba": fixtures.scored_proba}


def t(name: str) -> Query:
    if name in VIEWS:
        return VIEWS[name]
    return lambda spark, sf: table(spark, sf, name)


def simple(name: str, op: Callable[[DataFrame], DataFrame], source: str) -> None:
    load = t(source)
    QUERIES[name] = lambda spark, sf: op(load(spark, sf))


def rounded(op: Callable[[DataFrame], DataFrame], digits: int = 6) -> Callable[[DataFrame], DataFrame]:
    """Round the double columns of an operator's output (computed fills, fences, sums) for comparison."""
    from pyspark.sql import functions as F_

    def run(df):
        out = op(df)
        return out.select(*[F_.round(F_.col(f"`{c}`"), digits).alias(c) if d == "double" else F_.col(f"`{c}`")
                            for c, d in out.dtypes])
    return run


# ---------------------------------------------------------------- 2.2 profiling
simple("profile_overview", pr.profile_overview, "dirty")
simple("classify_columns", pr.classify_columns, "dirty")
simple("classify_columns_documents", pr.classify_columns, "documents")
simple("sample_values", pr.sample_values, "dirty")
simple("profile_numeric", pr.profile_numeric, "lineitem")
simple("iqr_outlier_count", pr.iqr_outlier_count, "dirty")
simple("top_values", pr.top_values, "dirty")
simple("profile_columns", pr.profile_columns, "dirty")
simple("column_recommendation", pr.column_recommendation, "dirty")
simple("quality_missing_dup_penalty",
       lambda df: pr.quality_score(df).select("missing_penalty", "duplicate_penalty"), "dirty")
simple("quality_outlier_penalty", lambda df: pr.quality_score(df).select("outlier_penalty"), "dirty")
simple("quality_datatype_penalty", lambda df: pr.quality_score(df).select("datatype_penalty"), "documents")
simple("quality_constant_penalty", lambda df: pr.quality_score(df).select("constant_penalty"), "dirty")
simple("quality_score", pr.quality_score, "dirty")
simple("class_counts", pr.class_counts, "dirty")
simple("target_candidates", pr.target_candidates, "dirty")
simple("quality_issues", pr.quality_issues, "dirty")
simple("issue_columns", pr.issue_columns, "dirty")
simple("size_estimate", pr.size_estimate, "orders")

# ---------------------------------------------------------------- 2.3 / 2.4 cleaning
from quarry.operators import clean as cl  # noqa: E402
from quarry.plans.cleaning_plans import APPLY_PLAN  # noqa: E402

simple("missing_issues", cl.missing_issues, "dirty")
simple("missing_severity", lambda df: cl.missing_severity(cl.missing_issues(df)), "dirty")
simple("duplicate_issue", cl.duplicate_issue, "dirty")
simple("outlier_issues", cl.outlier_issues, "dirty")
simple("numeric_type_issues", cl.numeric_type_issues, "dirty")
simple("datetime_type_issues", cl.datetime_type_issues, "dirty")
simple("issue_summary", lambda df: cl.issue_summary(cl.analyze_issues(df)), "dirty")
simple("convert_numeric", lambda df: cl.convert_numeric(df, "cust_txt"), "dirty")
simple("convert_datetime", lambda df: cl.convert_datetime(df, "date_txt"), "dirty")
simple("fill_median", rounded(lambda df: cl.fill_median(df, "amount")), "dirty")
simple("fill_mean", rounded(lambda df: cl.fill_mean(df, "amount")), "dirty")
simple("fill_mode", lambda df: cl.fill_mode(df, "priority"), "dirty")
simple("fill_constant", lambda df: cl.fill_constant(df, "priority", "Unknown"), "dirty")
simple("drop_column", lambda df: cl.drop_column(df, "mostly_null"), "dirty")
simple("drop_rows_missing", lambda df: cl.drop_rows_missing(df, ["amount", "priority"]), "dirty")
simple("drop_duplicates", cl.drop_duplicates, "dirty")
simple("winsorize", rounded(lambda df: cl.winsorize(df, "amount")), "dirty")
simple("drop_outlier_rows", lambda df: cl.drop_outlier_rows(df, "amount"), "dirty")
simple("apply_cleaning", rounded(lambda df: cl.apply_cleaning(df, APPLY_PLAN).data), "dirty")
simple("cleaning_report", lambda df: cl.apply_cleaning(df, APPLY_PLAN).report, "dirty")
simple("auto_clean", rounded(lambda df: cl.auto_clean(df).data), "dirty")

# ---------------------------------------------------------------- 2.5 exploratory analysis
from quarry.operators import eda as ed  # noqa: E402

simple("eda_overview", ed.eda_overview, "dirty")
simple("descriptive_stats", ed.descriptive_stats, "lineitem")
simple("shape_labels", lambda df: ed.shape_labels(ed.descriptive_stats(df)), "lineitem")
simple("eda_outliers", ed.eda_outliers, "dirty")
simple("eda_outlier_samples", lambda df: ed.outlier_samples(df, "o_orderkey"), "dirty")
simple("pearson_matrix", ed.pearson_matrix, "lineitem")
simple("pearson_matrix_nulls", ed.pearson_matrix, "dirty")
simple("spearman_matrix", ed.spearman_matrix, "lineitem")
simple("spearman_matrix_nulls", ed.spearman_matrix, "dirty")
simple("top_correlations", lambda df: ed.top_correlations(ed.pearson_matrix(df)), "lineitem")
simple("histograms", ed.histograms, "lineitem")
simple("categorical_breakdown", ed.categorical_breakdown, "dirty")
QUERIES["pick_value_column"] = lambda spark, sf: spark.createDataFrame(
    [(ed.pick_value_column(table(spark, sf, "orders"), target="o_totalprice"),)], "value_column string")
simple("monthly_totals", rounded(lambda df: ed.monthly_totals(df, "o_totalprice")), "orders")
simple("monthly_moving_avg", lambda df: ed.monthly_moving_avg(ed.monthly_totals(df, "o_totalprice")), "orders")
simple("weekly_totals", lambda df: ed.weekly_totals(df, "value"), "events")
simple("missing_ranking", ed.missing_ranking, "dirty")
simple("box_plot_stats", ed.box_plot_stats, "lineitem")
simple("outlier_rows", lambda df: ed.outlier_rows(df, "o_orderkey"), "dirty")
simple("ols_trend", lambda df: ed.ols_trend(df, "l_quantity", "l_extendedprice"), "lineitem")
simple("insights", ed.insights, "dirty")
simple("table_fingerprint", ed.table_fingerprint, "orders")

# ---------------------------------------------------------------- 2.9 evaluation metrics
from pyspark.sql import functions as F  # noqa: E402

from quarry.functions.frames import one_row_join  # noqa: E402
from quarry.operators import metrics as ev  # noqa: E402

PROBA_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PROBA_COLS = [f"p{i}" for i in range(len(PROBA_CLASSES))]
simple("accuracy", ev.accuracy, "scored_multi")
simple("weighted_precision", ev.weighted_precision, "scored_multi")
simple("weighted_recall", ev.weighted_recall, "scored_multi")
simple("weighted_f1", ev.weighted_f1, "scored_multi")
simple("roc_auc", ev.roc_auc, "scored_binary")
simple("roc_auc_ovr", lambda df: ev.roc_auc_ovr(df, PROBA_CLASSES, PROBA_COLS), "scored_proba")
simple("log_loss", lambda df: ev.log_loss(df, PROBA_CLASSES, PROBA_COLS), "scored_proba")
simple("confusion_matrix", ev.confusion_matrix, "scored_multi")
simple("classification_report", ev.classification_report, "scored_multi")
for _m in ["mae", "mse", "rmse", "r2", "explained_variance", "median_absolute_error", "mape"]:
    simple(_m, getattr(ev, _m), "scored_regression")
simple("evaluate", lambda df: ev.evaluate(df, "regression"), "scored_regression")
simple("evaluate_binary", lambda df: ev.evaluate(df, "classification", score="score"), "scored_binary")


def _leaderboard(spark, sf):
    """Three prediction columns over orders, evaluated and ranked on r2."""
    df = fixtures.scored_regression(spark, sf)
    mean = df.agg(F.avg("label").alias("_m"))
    baseline = one_row_join(df, mean).withColumn("prediction", F.col("_m")).drop("_m")
    cands = {
        "scored": df,
        "inflated": df.withColumn("prediction", F.col("label") * 1.05),
        "mean_baseline": baseline,
    }
    rows = None
    for name, d in cands.items():
        r = ev.regression_scores(d).select(F.lit(name).alias("model"), "*")
        rows = r if rows is None else rows.unionByName(r)
    return ev.metric_leaderboard(rows, "regression")


QUERIES["metric_leaderboard"] = _leaderboard
simple("roc_curve_points", ev.roc_curve_points, "scored_binary")
simple("residual_histogram", ev.residual_histogram, "scored_regression")

# ---------------------------------------------------------------- 2.6 validation and preparation
from pyspark.ml.functions import vector_to_array  # noqa: E402

from quarry.operators import prepare as dp  # noqa: E402
from quarry.operators.stages import MedianStandardScaler  # noqa: E402


def _one(spark, schema: str, *values):
    return spark.createDataFrame([tuple(values)], schema)


simple("validate_dataset", dp.validate_dataset, "orders")
QUERIES["detect_target"] = lambda spark, sf: _one(spark, "target string", dp.detect_target(table(spark, sf, "orders")))
simple("validate_target", lambda df: dp.validate_target(df, "o_orderpriority"), "orders")
simple("detect_problem_type", lambda df: dp.detect_problem_type_df(df, "o_totalprice"), "orders")
simple("detect_problem_type_ratio", lambda df: dp.detect_problem_type_df(df, "l_quantity"), "lineitem")
simple("split_features_target", lambda df: dp.split_features_target(df, "o_totalprice")[0], "orders")
simple("detect_feature_types", dp.feature_types_table, "orders")
simple("convert_datetime_features",
       lambda df: (lambda out: out.withColumns({c: F.col(c).cast("string") for c in out.columns
                                                if dict(out.dtypes)[c] == "timestamp_ntz"}))(
           dp.convert_datetime_features(df)[0]), "dirty")
QUERIES["detect_id_columns"] = lambda spark, sf: spark.createDataFrame(
    [(c,) for c in dp.detect_id_columns(table(spark, sf, "orders"))], "column string")
simple("class_imbalance", lambda df: dp.class_imbalance(df, "o_orderstatus"), "orders")


def _impute_scale(df):
    cols = ["o_orderkey", "amount", "const_one"]
    model = MedianStandardScaler(inputCols=cols, outputCols=[f"__num_{i}" for i in range(len(cols))]).fit(df)
    out = model.transform(df)
    return out.withColumns({f"__num_{i}": F.round(f"__num_{i}", 6) for i in range(len(cols))})


simple("impute_scale_numeric", _impute_scale, "dirty")


def _impute_onehot(df):
    pipe = dp.build_preprocessor([], ["priority"], features_col="onehot").fit(df)
    return pipe.transform(df).select("o_orderkey", vector_to_array("onehot").alias("onehot"))


simple("impute_onehot_categorical", _impute_onehot, "dirty")
simple("train_test_split", lambda df: dp.mark_split(df, "o_orderkey").select(
    "o_orderkey", F.col("_is_test").alias("is_test")), "orders")
simple("train_test_split_stratified", lambda df: dp.mark_split(df, "o_orderkey", stratify="o_orderstatus").select(
    "o_orderkey", F.col("_is_test").alias("is_test")), "orders")


def _assemble(df):
    out = dp.assemble_features(df, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    arr = vector_to_array("features")
    # the scaled slot is rounded to 9 dp so the comparison is not at the mercy of the last bit
    return out.select("o_orderkey", F.concat(F.array(F.round(arr[0], 9)), F.slice(arr, 2, 1 << 20)).alias("features"))


simple("assemble_features", _assemble, "orders")


def _prepare_summary(spark, sf):
    p = dp.prepare_dataset(table(spark, sf, "orders"), target="o_orderstatus", key="o_orderkey")
    return _one(spark, "target string, problem_type string, n_train long, n_test long, numerical string, "
                "categorical string, id_columns string, is_imbalanced boolean",
                p.target, p.problem_type, p.train.count(), p.test.count(), ",".join(p.numerical_columns),
                ",".join(p.categorical_columns), ",".join(p.id_columns), p.is_imbalanced)


QUERIES["prepare_dataset"] = _prepare_summary

# ---------------------------------------------------------------- 2.7 feature engineering
from quarry.operators import features as fe  # noqa: E402

VIEWS["fe_input"] = fixtures.fe_input
CYCLIC = ["month_sin", "month_cos", "weekday_sin", "weekday_cos"]


def _round_cyclic(df, prefix):
    return df.withColumns({f"{prefix}_{c}": F.round(f"{prefix}_{c}", 6) for c in CYCLIC})


def _columns_df(spark, cols, schema="column string"):
    return spark.createDataFrame([(c,) for c in cols], schema)


simple("remove_id_features", fe.remove_id_features, "fe_input")
simple("datetime_features", lambda df: _round_cyclic(fe.datetime_features(df), "order_date"), "fe_input")
simple("cyclic_features", lambda df: _round_cyclic(fe.cyclic_features(df, "o_orderdate"), "o_orderdate"), "orders")
simple("bool_to_int", fe.bool_to_int, "fe_input")
simple("rare_categories", fe.rare_categories, "fe_input")
QUERIES["drop_constant"] = lambda spark, sf: _columns_df(spark, fe.constant_columns(t("fe_input")(spark, sf)))


def _low_variance(spark, sf):
    df = t("fe_input")(spark, sf)
    kept = set(fe.drop_low_variance(df).columns)
    nums = [c for c, d in df.dtypes if d in ("bigint", "int", "double")]
    return spark.createDataFrame([(c, c in kept) for c in nums], "column string, kept boolean")


QUERIES["drop_low_variance"] = _low_variance
QUERIES["drop_correlated"] = lambda spark, sf: _columns_df(spark, fe.correlated_columns(t("fe_input")(spark, sf)))
simple("interaction_features", lambda df: fe.interaction_features(
    df, [("total_price", "acct_balance"), ("acct_balance", "nation"), ("missing", "nation")]), "fe_input")
simple("cap_outliers", rounded(fe.cap_outliers), "dirty")
simple("fill_zero", fe.fill_zero, "dirty")
simple("mutual_information", lambda df: fe.mutual_information(df, "status", "classification").select(
    "column", F.round("mi", 6).alias("mi")), "fe_input")


def _select_k(spark, sf):
    out = fe.select_k_best(t("fe_input")(spark, sf), "status", "classification", k=3)
    return spark.createDataFrame(list(enumerate(out.columns)), "position long, column string")


QUERIES["select_k_best"] = _select_k


def _engineer(spark, sf):
    return fe.engineer_features(t("fe_input")(spark, sf), "status", select_k=5, problem_type="classification").ledger


QUERIES["engineer_features"] = _engineer

# ---------------------------------------------------------------- 2.8 training and selection
from quarry.operators import learners as ln  # noqa: E402
from quarry.operators import models as md  # noqa: E402

VIEWS["doc_model"] = fixtures.doc_model
VIEWS["order_model"] = fixtures.order_model


def _emb_split(spark, sf):
    e = table(spark, sf, "embeddings")
    marked = dp.mark_split(e, "vec_id")
    return marked.where(~F.col("_is_test")).drop("_is_test"), marked.where(F.col("_is_test")).drop("_is_test")


def _nb(spark, sf):
    train, test = _emb_split(spark, sf)
    m = ln.GaussianNB(featuresCol="embedding", labelCol="label").fit(train)
    return m.transform(test).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


def _knn(spark, sf):
    train, test = _emb_split(spark, sf)
    m = ln.KNNClassifier(featuresCol="embedding", labelCol="label", k=5).fit(train)
    return m.transform(test).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


def _ols(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    li = table(spark, sf, "lineitem").withColumn("label_value", F.col("l_extendedprice").cast("double"))
    vec = VectorAssembler(inputCols=["l_quantity"], outputCol=md.FEATURES).transform(li)
    stages = md.candidate_models("regression")["Linear Regression"].stages(vec)
    m = Pipeline(stages=stages).fit(vec).stages[-1]
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))],
                                 "slope double, intercept double")


QUERIES["gaussian_nb"] = _nb
QUERIES["knn_classify"] = _knn
QUERIES["linear_regression"] = _ols
simple("balanced_class_weights", lambda df: md.balanced_class_weights(df, "o_orderstatus").select(
    "o_orderstatus", F.round("class_weight", 6).alias("class_weight")).distinct(), "orders")


def _prep_docs(spark, sf):
    return dp.prepare_dataset(t("doc_model")(spark, sf), target="quality", key="doc_id")


def _prep_orders(spark, sf):
    return dp.prepare_dataset(t("order_model")(spark, sf), target="o_totalprice", key="o_orderkey")


def _fit_one(name: str, problem: str):
    def run(spark, sf):
        prep = _prep_docs(spark, sf) if problem == "classification" else _prep_orders(spark, sf)
        cands = md.candidate_models(problem)
        res = md.train_one(prep, cands[name], problem, cv=0)
        if res.error:
            raise RuntimeError(res.error)
        out = res.model.transform(prep.test)
        pred = "predicted_label" if problem == "classification" else "prediction"
        return out.select(F.col(prep.key).alias("key"), F.col(pred).cast("string").alias("prediction"))
    return run


for _key, _name in [("fit_logistic", "Logistic Regression"), ("fit_rf_classifier", "Random Forest"),
                    ("fit_extra_trees_classifier", "Extra Trees"), ("fit_gbt_classifier", "Gradient Boosting"),
                    ("fit_adaboost", "AdaBoost"), ("fit_tree_classifier", "Decision Tree"),
                    ("fit_svm_classifier", "SVM")]:
    QUERIES[_key] = _fit_one(_name, "classification")
for _key, _name in [("fit_rf_regressor", "Random Forest"), ("fit_extra_trees_regressor", "Extra Trees"),
                    ("fit_gbt_regressor", "Gradient Boosting"), ("fit_tree_regressor", "Decision Tree"),
                    ("fit_svr", "SVR")]:
    QUERIES[_key] = _fit_one(_name, "regression")


def _kmeans(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").withColumn("features", array_to_vector("embedding"))
    m = md.kmeans_best_of(e, k=3, n_init=10)
    return m.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


QUERIES["kmeans"] = _kmeans


def _candidates(spark, sf):
    df = t("doc_model")(spark, sf)
    ptype = dp.detect_problem_type(df, "quality")
    return spark.createDataFrame([(ptype, n) for n in md.candidate_models(ptype)], "problem_type string, model string")


QUERIES["candidate_models"] = _candidates


def _compare(spark, sf):
    return md.train_and_compare(_prep_docs(spark, sf), parallelism=4).leaderboard


QUERIES["train_and_compare"] = lambda spark, sf: _compare(spark, sf).drop("train_time_sec", "predict_time_sec")
QUERIES["select_best"] = lambda spark, sf: md.select_best(_compare(spark, sf)).select("model", "rank")
QUERIES["compact_leaderboard"] = lambda spark, sf: md.compact_leaderboard(_compare(spark, sf)).select("model", "score", "rank")


def _cv(spark, sf):
    prep = _prep_docs(spark, sf)
    res = md.train_one(prep, md.candidate_models("classification")["Decision Tree"],
                       "classification", cv=5)
    return spark.createDataFrame([(res.name, res.cv_mean, res.cv_std)], "model string, cv_mean double, cv_std double")


def _search(spark, sf):
    prep = _prep_docs(spark, sf)
    res = md.train_one(prep, md.candidate_models("classification")["Decision Tree"],
                       "classification", cv=0, tune=True)
    return spark.createDataFrame([(res.name, str(res.params.get("maxDepth")), str(res.params.get("minInstancesPerNode")))],
                                 "model string, max_depth string, min_instances string")


QUERIES["cross_validate"] = _cv
QUERIES["random_search"] = _search
QUERIES["cluster_table"] = lambda spark, sf: md.cluster_table(t("fe_input")(spark, sf), k=3)

# ---------------------------------------------------------------- 2.1 sources and sinks
from quarry.session import scratch_dir  # noqa: E402
from quarry.sources import files as io  # noqa: E402
from quarry.sources import registry as reg  # noqa: E402


def _scan_csv(spark, sf):
    path = f"{scratch_dir(spark, 'csv')}/dirty.csv"
    io.sink_csv(dirty(spark, sf), path)
    return io.scan_csv(spark, path)


def _sink_csv(spark, sf):
    li = table(spark, sf, "lineitem")
    path = f"{scratch_dir(spark, 'csv')}/lineitem.csv"
    io.sink_csv(li, path)
    return io.scan_csv(spark, path, schema=li.schema)


def _sink_json(spark, sf):
    stats = ed.descriptive_stats(table(spark, sf, "lineitem"))
    path = scratch_dir(spark, "eda-json")
    io.sink_eda_json({"descriptive_stats": stats, "histograms": ed.histograms(table(spark, sf, "lineitem"))}, path)
    return io.read_eda_json(spark, path, "descriptive_stats", stats.schema)


def _metrics_long(spark, sf):
    m = ev.regression_scores(fixtures.scored_regression(spark, sf))
    return m.unpivot([], m.columns, "metric", "value")


def _importance(spark, sf):
    """Signed Pearson r of each lineitem number with the extended price, as an importance table."""
    m = ed.pearson_matrix(table(spark, sf, "lineitem"), digits=15)
    return m.where((F.col("col_b") == "l_extendedprice") & (F.col("col_a") != "l_extendedprice")).select(
        F.col("col_a").alias("feature"), F.round("r", 6).alias("importance"))


def _ranked_sink(spark, sf):
    from quarry.operators.explain import feature_ranking

    path = f"{scratch_dir(spark, 'report')}/feature_importance.csv"
    feature_ranking(_importance(spark, sf)).write.mode("overwrite").option("header", True).csv(path)
    return io.scan_csv(spark, path, schema="Rank int, Feature string, Importance double")


BOARD_TS = "2024-01-01T00:00:00"


def _board(spark, sf, path: str | None = None):
    path = path or f"{scratch_dir(spark, 'board')}/leaderboard"
    reg_m = ev.regression_scores(fixtures.scored_regression(spark, sf)).first().asDict()
    infl = fixtures.scored_regression(spark, sf).withColumn("prediction", F.col("label") * 1.05)
    infl_m = ev.regression_scores(infl).first().asDict()
    clf_m = ev.classification_scores(fixtures.scored_binary(spark, sf)).first().asDict()
    meta_r = {"model": "scored", "model_type": "table", "problem_type": "regression", "target": "label"}
    meta_c = {"model": "scored", "model_type": "table", "problem_type": "classification", "target": "label"}
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "reg_scored", meta_r, reg_m, BOARD_TS))
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "reg_inflated", meta_r | {"model": "inflated"},
                                                           infl_m, BOARD_TS))
    reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "clf_binary", meta_c, clf_m, BOARD_TS))
    # same run again: replaces its row
    return reg.leaderboard_upsert(spark, path, reg.leaderboard_row(spark, "reg_scored", meta_r | {"model": "rescored"},
                                                                  reg_m, BOARD_TS))


QUERIES["scan_csv"] = _scan_csv
QUERIES["sink_csv"] = _sink_csv
QUERIES["sink_eda_json"] = _sink_json
QUERIES["metrics_long"] = _metrics_long
QUERIES["ranked_importance_sink"] = _ranked_sink
QUERIES["leaderboard_upsert"] = _board


def _board_load(spark, sf):
    path = f"{scratch_dir(spark, 'board')}/leaderboard"
    _board(spark, sf, path)
    return reg.leaderboard_load(spark, path).where(F.col("run_name") == "clf_binary")


QUERIES["leaderboard_load"] = _board_load
simple("table_summary", io.table_summary, "dirty")
simple("preview", lambda df: io.preview(df, "o_orderkey", 10), "orders")

# ---------------------------------------------------------------- runs, scoring, explainability, streaming
_RUNS: dict = {}


def _trained(spark, sf, name: str = "Decision Tree"):
    """Train (once per session, scale and learner) on the labelled documents and save the run."""
    k = (id(spark), sf, name)
    if k not in _RUNS:
        prep = _prep_docs(spark, sf)
        res = md.train_one(prep, md.candidate_models("classification")[name], "classification", cv=0)
        if res.error:
            raise RuntimeError(res.error)
        root = scratch_dir(spark, "runs")
        run_dir = f"{root}/{name.replace(' ', '%20')}_run"
        reg.save_run(spark, run_dir, res.model, {"model": name, "model_type": type(res.model.stages[-2]).__name__,
                                                 "problem_type": "classification", "target": prep.target},
                     res.metrics, prep.feature_columns, res.params)
        _RUNS[k] = (prep, res, root, run_dir)
    return _RUNS[k]


def _save_load(spark, sf):
    prep, res, root, run_dir = _trained(spark, sf)
    model, meta, metrics = reg.load_run(spark, run_dir)
    return model.transform(prep.test).select(F.col("doc_id").alias("key"), "predicted_label")


def _registry(spark, sf):
    _trained(spark, sf, "Decision Tree")
    _, _, root_nb, _ = _trained(spark, sf, "Naive Bayes")
    _, _, root_dt, _ = _trained(spark, sf, "Decision Tree")
    return reg.run_registry(spark, root_dt).unionByName(reg.run_registry(spark, root_nb))


QUERIES["save_load_pipeline"] = _save_load
QUERIES["run_registry"] = _registry

from quarry.operators import explain as ex  # noqa: E402
from quarry.operators import score as sc  # noqa: E402


def _run_model(spark, sf, name="Decision Tree"):
    prep, res, root, run_dir = _trained(spark, sf, name)
    model, meta, _ = reg.load_run(spark, run_dir)
    return prep, model, meta


QUERIES["load_run"] = lambda spark, sf: (lambda pm: spark.createDataFrame(
    [(pm[2]["model"], pm[2]["target"], pm[2]["problem_type"], len(pm[1].stages))],
    "model string, target string, problem_type string, n_stages int"))(_run_model(spark, sf))
QUERIES["validate_scoring_input"] = lambda spark, sf: sc.validate_scoring_input(
    t("doc_model")(spark, sf).drop("toxic"), _run_model(spark, sf)[0].feature_columns)
QUERIES["transform_features"] = lambda spark, sf: (lambda pm: sc.transform_features(
    pm[1], pm[0].test, pm[0].feature_columns).select(vector_to_array("features").alias("features")))(_run_model(spark, sf))
QUERIES["predict"] = lambda spark, sf: (lambda pm: sc.predict(pm[1], pm[0].test).select(
    "doc_id", "prediction"))(_run_model(spark, sf))
QUERIES["decode_labels"] = lambda spark, sf: (lambda pm: sc.predict(pm[1], pm[0].test).select(
    F.col("prediction").alias("label")).distinct())(_run_model(spark, sf))
QUERIES["predict_proba"] = lambda spark, sf: (lambda pm: sc.predict_proba(pm[1], pm[0].test).select(
    "doc_id", *[c for c in sc.predict_proba(pm[1], pm[0].test).columns if c.startswith("proba_")]))(
    _run_model(spark, sf))
QUERIES["score_table"] = lambda spark, sf: (lambda pm: sc.score_table(
    pm[1], pm[0].test.drop("quality"), pm[0].feature_columns))(_run_model(spark, sf))


def _score_csv(spark, sf):
    prep, model, _ = _run_model(spark, sf)
    path = f"{scratch_dir(spark, 'scores')}/scores.csv"
    sc.score_to_csv(model, prep.test.drop("quality"), path, prep.feature_columns)
    return io.scan_csv(spark, path)


QUERIES["score_to_csv"] = _score_csv


def _names(pm):
    return ex.slot_names(sc.preprocessing_stages(pm[1]).transform(pm[0].test))


QUERIES["tree_importance"] = lambda spark, sf: (lambda pm: ex.tree_importance(pm[1], _names(pm)))(
    _run_model(spark, sf))
QUERIES["linear_importance"] = lambda spark, sf: (lambda pm: ex.linear_importance(pm[1], _names(pm)))(
    _run_model(spark, sf, "Logistic Regression"))
QUERIES["permutation_importance"] = lambda spark, sf: (lambda pm: ex.permutation_importance(
    pm[1], pm[0].test, "doc_id", "quality", "classification", pm[0].feature_columns))(
    _run_model(spark, sf, "Naive Bayes"))


def _shap(spark, sf, name="Decision Tree"):
    prep, model, _ = _run_model(spark, sf, name)
    return ex.shap_values(model, prep.test, prep.train, "doc_id", prep.feature_columns, "classification")


QUERIES["shapley_values"] = _shap
QUERIES["explain_prediction"] = lambda spark, sf: (lambda s: ex.explain_prediction(
    s, "doc_id", s.agg(F.min("doc_id")).first()[0]))(_shap(spark, sf))
QUERIES["feature_ranking"] = lambda spark, sf: ex.feature_ranking(_importance(spark, sf))
QUERIES["shap_summary"] = lambda spark, sf: ex.shap_summary(_shap(spark, sf))


def _explain_model(spark, sf):
    prep, model, _ = _run_model(spark, sf, "Naive Bayes")
    out = ex.explain_model(model, prep.test, prep.train, "doc_id", "quality", "classification", prep.feature_columns)
    mean_abs = ex.shap_summary(out["shap"])
    return out["importance"].join(mean_abs, "feature", "left").withColumn("method", F.lit(out["method"]))


QUERIES["explain_model"] = _explain_model


def _stream(spark, sf):
    from quarry.streaming.scoring import score_stream, start_scoring

    prep, model, _ = _run_model(spark, sf)
    labels = table(spark, sf, "labels")

    def features(docs):
        words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
        return docs.join(labels, "doc_id").select(
            "doc_id", "lang", "source", "n_chars", words.alias("n_words"),
            F.size(F.split(F.col("text"), "\n")).alias("n_lines"),
            (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("chars_per_word"),
            F.length(F.regexp_replace(F.col("text"), r"[^0-9]", "")).alias("n_digits"),
            F.length(F.regexp_replace(F.col("text"), r"[^A-Z]", "")).alias("n_upper"), "toxic")

    schema = table(spark, sf, "documents").schema
    scored = score_stream(spark, model, f"{sf}/documents*.parquet", schema, prepare=features)
    sink = f"{scratch_dir(spark, 'stream-out')}/scored"
    start_scoring(scored.select("doc_id", "prediction"), sink, scratch_dir(spark, "stream-ckpt"), once=True).awaitTermination()
    return spark.read.parquet(sink)


QUERIES["score_stream"] = _stream

# ---------------------------------------------------------------- training loop pieces and the end-to-end run
from quarry.plans.automl import run_analysis  # noqa: E402


def _build_pipeline(spark, sf):
    prep = _prep_docs(spark, sf)
    cand = md.candidate_models("classification")["Decision Tree"]
    pipe = md.build_pipeline(prep, cand.stages(prep.train), "classification", ["0", "1"])
    return spark.createDataFrame([(i, type(s).__name__) for i, s in enumerate(pipe.getStages())],
                                 "position int, stage string")


def _train_one(spark, sf):
    prep = _prep_docs(spark, sf)
    r = md.train_one(prep, md.candidate_models("classification")["Naive Bayes"], "classification")
    return spark.createDataFrame([(r.name, r.metrics.get("accuracy"), r.cv_mean, r.cv_std, r.feature_count, r.error)],
                                 "model string, accuracy double, cv_mean double, cv_std double, feature_count int, "
                                 "error string")


def _train_all(spark, sf):
    results = md.train_all(_prep_orders(spark, sf), parallelism=4)
    return md.results_table(spark, results, "regression").drop("train_time_sec", "predict_time_sec")


QUERIES["build_pipeline"] = _build_pipeline
QUERIES["train_one"] = _train_one
QUERIES["train_all"] = _train_all
QUERIES["model_leaderboard"] = lambda spark, sf: md.model_leaderboard(_train_all(spark, sf), "regression").select(
    "model", "r2", "rank")
QUERIES["run_pipeline"] = lambda spark, sf: run_analysis(
    spark, t("doc_model")(spark, sf), "quality", "doc_id", scratch_dir(spark, "runs"), parallelism=4).record
