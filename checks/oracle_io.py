"""Oracle SQL for sources, sinks and the leaderboard."""

from __future__ import annotations

from checks.oracle import SCHEMAS, qi, union, wrap
from checks.oracle_metrics import classification_scores, regression_scores


def scan_csv() -> str:
    return wrap("""SELECT o_orderkey, amount, priority, CAST(NULLIF(cust_txt, 'n/a') AS BIGINT) AS cust_txt, date_txt,
       is_final, CAST(const_one AS BIGINT) AS const_one, mostly_null FROM dirty""", "dirty")


def metrics_long() -> str:
    cols = ["mae", "mse", "rmse", "r2", "explained_variance", "median_absolute_error", "mape"]
    body = regression_scores()
    return union([f"SELECT '{c}' AS metric, {c} AS value FROM ({body})" for c in cols])


def _importance() -> str:
    parts = []
    for c, t in SCHEMAS["lineitem"]:
        if t in ("bigint", "int", "double") and c != "l_extendedprice":
            x, y = f"CAST({qi(c)} AS DOUBLE)", "l_extendedprice"
            parts.append(f"SELECT '{c}' AS feature, round(CASE WHEN stddev_pop({x}) * stddev_pop({y}) <> 0 THEN "
                         f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 6) AS importance FROM lineitem")
    return union(parts)


def ranked_importance() -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY abs(importance) DESC, feature) AS INT) AS \"Rank\", "
            f"feature AS \"Feature\", importance AS \"Importance\" FROM ({_importance()})")


def leaderboard() -> str:
    ts = "'2024-01-01T00:00:00'"
    reg = regression_scores()
    infl = regression_scores("scored_regression", "label * 1.05")
    clf = classification_scores("scored_binary")
    rcols = ["mae", "mse", "rmse", "r2", "explained_variance", "median_absolute_error", "mape"]
    ccols = ["accuracy", "precision", "recall", "f1"]
    nulls_c = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ccols)
    nulls_r = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in rcols)

    def meta(model, ptype):
        return (f"'{model}' AS meta_model, 'table' AS meta_model_type, '{ptype}' AS meta_problem_type, "
                f"'label' AS meta_target")
    return f"""
SELECT 'reg_scored' AS run_name, {ts} AS timestamp, {meta('rescored', 'regression')}, {', '.join(rcols)}, {nulls_c}
FROM ({reg})
UNION ALL
SELECT 'reg_inflated', {ts}, {meta('inflated', 'regression')}, {', '.join(rcols)}, {nulls_c} FROM ({infl})
UNION ALL
SELECT 'clf_binary', {ts}, {meta('scored', 'classification')}, {nulls_r}, {', '.join(ccols)} FROM ({clf})"""


def empty_board() -> str:
    return ("SELECT CAST(NULL AS VARCHAR) AS run_name, CAST(NULL AS VARCHAR) AS timestamp, "
            "CAST(NULL AS VARCHAR) AS meta_model, CAST(NULL AS VARCHAR) AS meta_model_type, "
            "CAST(NULL AS VARCHAR) AS meta_problem_type, CAST(NULL AS VARCHAR) AS meta_target FROM orders WHERE false")


def table_summary(table: str) -> str:
    return wrap(union([f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({qi(c)}) AS nulls, "
                       f"count(*) AS rows FROM {table}" for c, t in SCHEMAS[table]]), table)
