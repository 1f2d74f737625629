"""Oracle SQL per registered query key (DuckDB)."""

from __future__ import annotations

from checks import oracle as o

ORACLE: dict[str, str] = {}


def _qs(table: str) -> str:
    return o.quality_score(table)


# ---------------------------------------------------------------- 2.2 profiling
ORACLE["profile_overview"] = o.profile_overview("dirty")
ORACLE["classify_columns"] = o.classify_columns("dirty")
ORACLE["classify_columns_documents"] = o.classify_columns("documents")
ORACLE["sample_values"] = o.sample_values("dirty")
ORACLE["profile_numeric"] = o.profile_numeric("lineitem")
ORACLE["iqr_outlier_count"] = o.iqr_outlier_count("dirty")
ORACLE["top_values"] = o.top_values("dirty", ["priority", "cust_txt", "is_final", "mostly_null"])
ORACLE["profile_columns"] = o.profile_columns("dirty")
ORACLE["column_recommendation"] = o.column_recommendation("dirty")
ORACLE["quality_missing_dup_penalty"] = f"SELECT missing_penalty, duplicate_penalty FROM ({_qs('dirty')})"
ORACLE["quality_outlier_penalty"] = f"SELECT outlier_penalty FROM ({_qs('dirty')})"
ORACLE["quality_datatype_penalty"] = f"SELECT datatype_penalty FROM ({_qs('documents')})"
ORACLE["quality_constant_penalty"] = f"SELECT constant_penalty FROM ({_qs('dirty')})"
ORACLE["quality_score"] = _qs("dirty")
ORACLE["class_counts"] = o.class_counts("dirty")
ORACLE["target_candidates"] = o.target_candidates("dirty")
ORACLE["quality_issues"] = o.quality_issues("dirty")
ORACLE["issue_columns"] = o.issue_columns("dirty")
ORACLE["size_estimate"] = o.size_estimate("orders")

# ---------------------------------------------------------------- 2.3 / 2.4 cleaning
from checks import oracle_clean as oc  # noqa: E402

for _k in ["missing_issues", "missing_severity", "duplicate_issue", "outlier_issues", "numeric_type_issues",
           "datetime_type_issues", "issue_summary"]:
    ORACLE[_k] = getattr(oc, _k)("dirty")
for _k in ["convert_numeric", "convert_datetime", "fill_median", "fill_mean", "fill_mode", "fill_constant",
           "drop_column", "drop_rows_missing", "drop_duplicates", "winsorize", "drop_outlier_rows",
           "apply_cleaning", "cleaning_report", "auto_clean"]:
    ORACLE[_k] = getattr(oc, _k)()

# ---------------------------------------------------------------- 2.5 exploratory analysis
from checks import oracle_eda as oe  # noqa: E402

DIRTY_CATS = ["priority", "cust_txt", "is_final", "mostly_null"]
ORACLE["eda_overview"] = oe.eda_overview("dirty")
ORACLE["descriptive_stats"] = oe.descriptive_stats("lineitem")
ORACLE["shape_labels"] = oe.shape_labels("lineitem")
ORACLE["eda_outliers"] = oe.eda_outliers("dirty")
ORACLE["eda_outlier_samples"] = oe.outlier_samples("dirty", "o_orderkey")
ORACLE["pearson_matrix"] = oe.pearson_matrix("lineitem")
ORACLE["pearson_matrix_nulls"] = oe.pearson_matrix("dirty")
ORACLE["spearman_matrix"] = oe.spearman_matrix("lineitem")
ORACLE["spearman_matrix_nulls"] = oe.spearman_matrix("dirty")
ORACLE["top_correlations"] = oe.top_correlations("lineitem")
ORACLE["histograms"] = oe.histograms("lineitem")
ORACLE["categorical_breakdown"] = oe.categorical_breakdown("dirty", DIRTY_CATS)
ORACLE["pick_value_column"] = oe.pick_value_column("o_totalprice")
ORACLE["monthly_totals"] = oe.monthly_totals("orders", "o_orderdate", "o_totalprice")
ORACLE["monthly_moving_avg"] = oe.monthly_moving_avg("orders", "o_orderdate", "o_totalprice")
ORACLE["weekly_totals"] = oe.weekly_totals("events", "ts", "value")
ORACLE["missing_ranking"] = oe.missing_ranking("dirty")
ORACLE["box_plot_stats"] = oe.box_plot_stats("lineitem")
ORACLE["outlier_rows"] = oe.outlier_rows("dirty", "o_orderkey")
ORACLE["ols_trend"] = oe.ols_trend("lineitem", "l_quantity", "l_extendedprice")
ORACLE["insights"] = oe.insights("dirty", DIRTY_CATS)

# ---------------------------------------------------------------- 2.9 evaluation metrics
from checks import oracle_metrics as om  # noqa: E402

ORACLE["accuracy"] = om.accuracy("scored_multi")
ORACLE["weighted_precision"] = om.one("scored_multi", "precision")
ORACLE["weighted_recall"] = om.one("scored_multi", "recall")
ORACLE["weighted_f1"] = om.one("scored_multi", "f1")
ORACLE["roc_auc"] = om.roc_auc()
ORACLE["roc_auc_ovr"] = om.roc_auc_ovr()
ORACLE["log_loss"] = om.log_loss()
ORACLE["confusion_matrix"] = om.confusion_matrix()
ORACLE["classification_report"] = om.classification_report()
for _m in ["mae", "mse", "rmse", "r2", "explained_variance", "median_absolute_error", "mape"]:
    ORACLE[_m] = f"SELECT {_m} FROM ({om.regression_scores()})"
ORACLE["evaluate"] = om.regression_scores()
ORACLE["evaluate_binary"] = om.evaluate_binary()
ORACLE["metric_leaderboard"] = om.metric_leaderboard()
ORACLE["roc_curve_points"] = om.roc_curve_points()
ORACLE["residual_histogram"] = om.residual_histogram()

# ---------------------------------------------------------------- 2.6 validation and preparation
from checks import oracle_prepare as op  # noqa: E402

ORACLE["validate_dataset"] = op.validate_dataset("orders")
ORACLE["detect_target"] = op.detect_target_orders()
ORACLE["validate_target"] = op.validate_target("orders", "o_orderpriority")
ORACLE["detect_problem_type"] = op.detect_problem_type("orders", "o_totalprice")
ORACLE["detect_problem_type_ratio"] = op.detect_problem_type("lineitem", "l_quantity")
ORACLE["split_features_target"] = op.split_features("orders", "o_totalprice")
ORACLE["detect_feature_types"] = op.feature_types("orders")
ORACLE["convert_datetime_features"] = op.convert_datetime_features()
ORACLE["detect_id_columns"] = op.detect_id_columns("orders")
ORACLE["class_imbalance"] = op.class_imbalance("orders", "o_orderstatus")
ORACLE["impute_scale_numeric"] = op.impute_scale("dirty")
ORACLE["impute_onehot_categorical"] = op.impute_onehot("dirty", "priority", "o_orderkey")
ORACLE["train_test_split"] = op.train_test_split("orders", "o_orderkey")
ORACLE["train_test_split_stratified"] = op.stratified_split("orders", "o_orderkey", "o_orderstatus")

# ---------------------------------------------------------------- 2.7 feature engineering
from checks import oracle_features as of  # noqa: E402

ORACLE["remove_id_features"] = of.remove_id_features()
ORACLE["datetime_features"] = of.datetime_features()
ORACLE["cyclic_features"] = of.cyclic_features()
ORACLE["bool_to_int"] = of.bool_to_int()
ORACLE["rare_categories"] = of.rare_categories()
ORACLE["drop_constant"] = of.constant_columns("fe_input")
ORACLE["drop_low_variance"] = of.low_variance("fe_input")
ORACLE["drop_correlated"] = of.correlated("fe_input")
ORACLE["interaction_features"] = of.interaction_features()
ORACLE["cap_outliers"] = of.cap_outliers()
ORACLE["fill_zero"] = of.fill_zero()
ORACLE["mutual_information"] = of.mutual_information("fe_input", "status")

# ---------------------------------------------------------------- 2.8 training (exact learners)
from checks import oracle_models as omd  # noqa: E402

ORACLE["gaussian_nb"] = omd.gaussian_nb()
ORACLE["knn_classify"] = omd.knn_classify()
ORACLE["linear_regression"] = omd.linear_regression()
ORACLE["balanced_class_weights"] = omd.balanced_class_weights()

# ---------------------------------------------------------------- 2.1 sources and sinks
from checks import oracle_io as oio  # noqa: E402

ORACLE["scan_csv"] = oio.scan_csv()
ORACLE["sink_csv"] = "SELECT * FROM lineitem"
ORACLE["sink_eda_json"] = oe.descriptive_stats("lineitem")
ORACLE["metrics_long"] = oio.metrics_long()
ORACLE["ranked_importance_sink"] = oio.ranked_importance()
ORACLE["feature_ranking"] = oio.ranked_importance()
ORACLE["leaderboard_upsert"] = oio.leaderboard()
ORACLE["leaderboard_load"] = f"SELECT * FROM ({oio.leaderboard()}) WHERE run_name = 'clf_binary'"
ORACLE["table_summary"] = oio.table_summary("dirty")
ORACLE["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"

ORACLE["select_k_best"] = of.select_k_best(3)
ORACLE["assemble_features"] = op.assemble_features()
ORACLE["validate_scoring_input"] = op.validate_scoring_input()


# ---------------------------------------------------------------- computed doubles rounded to 6 dp (both sides)
_DOUBLES = {
    "fill_median": ["amount"], "fill_mean": ["amount"], "winsorize": ["amount"],
    "cap_outliers": ["o_orderkey", "amount", "const_one"],
    "apply_cleaning": ["o_orderkey", "amount", "cust_txt"], "auto_clean": ["amount", "cust_txt"],
    "monthly_totals": ["value"],
}


def _round_doubles(sql: str, doubles: list[str]) -> str:
    """Wrap an oracle so the listed double columns are rounded to 6 dp (the query rounds them too)."""
    return (f"SELECT * REPLACE ({', '.join(f'round({o.qi(c)}, 6) AS {o.qi(c)}' for c in doubles)}) "
            f"FROM ({sql})")


for _k, _cols in _DOUBLES.items():
    ORACLE[_k] = _round_doubles(ORACLE[_k], _cols)
