"""Oracle SQL for evaluation metrics on the scored views."""

from __future__ import annotations

from checks.oracle import wrap

EPS = "2.220446049250313e-16"
CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _per_class(table: str) -> str:
    return f"""c AS (SELECT CAST(label AS VARCHAR) AS a, CAST(prediction AS VARCHAR) AS p, count(*) AS n
       FROM {table} GROUP BY ALL),
cls AS (SELECT a AS k FROM c UNION SELECT p FROM c),
pc AS (SELECT k, COALESCE((SELECT sum(n) FROM c WHERE a = k AND p = k), 0) AS tp,
              COALESCE((SELECT sum(n) FROM c WHERE p = k), 0) AS npred,
              COALESCE((SELECT sum(n) FROM c WHERE a = k), 0) AS sup FROM cls),
m AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr,
                CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS rc FROM pc),
m2 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)"""


def classification_scores(table: str) -> str:
    return wrap(f"""WITH {_per_class(table)}
SELECT round(sum(tp) / sum(sup) * 100, 2) AS accuracy, round(sum(pr * sup) / sum(sup) * 100, 2) AS precision,
       round(sum(rc * sup) / sum(sup) * 100, 2) AS recall, round(sum(f1 * sup) / sum(sup) * 100, 2) AS f1 FROM m2""",
                table)


def one(table: str, col: str) -> str:
    return f"SELECT {col} FROM ({classification_scores(table)})"


def accuracy(table: str) -> str:
    return wrap(f"SELECT round(avg(CASE WHEN CAST(label AS VARCHAR) = CAST(prediction AS VARCHAR) THEN 1.0 ELSE 0.0 END)"
                f" * 100, 2) AS accuracy FROM {table}", table)


def _auc(table: str, score: str, pos: str) -> str:
    return f"""(SELECT CASE WHEN p > 0 AND n - p > 0 THEN (rs - p * (p + 1) / 2) / (p * (n - p)) END AS auc, p
 FROM (SELECT sum(CASE WHEN pos = 1 THEN rk ELSE 0 END) AS rs, sum(pos) AS p, count(*) AS n
       FROM (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk
             FROM (SELECT CAST({score} AS DOUBLE) AS s, {pos} AS pos FROM {table}))))"""


def roc_auc(table: str = "scored_binary") -> str:
    return wrap(f"SELECT round(auc, 4) AS roc_auc FROM {_auc(table, 'score', 'CASE WHEN label = 1 THEN 1 ELSE 0 END')}",
                table)


def roc_auc_ovr(table: str = "scored_proba") -> str:
    parts = " UNION ALL ".join(
        f"SELECT * FROM {_auc(table, f'p{i}', f'CASE WHEN label = {chr(39)}{c}{chr(39)} THEN 1 ELSE 0 END')}"
        for i, c in enumerate(CLASSES))
    return wrap(f"SELECT CASE WHEN count(*) FILTER (WHERE auc IS NULL) = 0 THEN round(sum(auc * p) / sum(p), 4) END "
                f"AS roc_auc FROM ({parts})", table)


def log_loss(table: str = "scored_proba") -> str:
    total = " + ".join(f"p{i}" for i in range(len(CLASSES)))
    case = "CASE " + " ".join(f"WHEN label = '{c}' THEN p{i} / ({total})" for i, c in enumerate(CLASSES)) + " END"
    return wrap(f"SELECT round(avg(-ln(greatest(least({case}, 1 - {EPS}), {EPS}))), 4) AS log_loss FROM {table}", table)


def binary_log_loss(table: str = "scored_binary") -> str:
    p = "CASE WHEN label = 1 THEN score ELSE 1 - score END"
    return wrap(f"SELECT round(avg(-ln(greatest(least({p}, 1 - {EPS}), {EPS}))), 4) AS log_loss FROM {table}", table)


def confusion_matrix(table: str = "scored_multi") -> str:
    return wrap(f"""WITH c AS (SELECT CAST(label AS VARCHAR) AS a, CAST(prediction AS VARCHAR) AS p, count(*) AS n
       FROM {table} GROUP BY ALL),
ls AS (SELECT a AS k FROM c UNION SELECT p FROM c)
SELECT x.k AS actual, y.k AS predicted, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM ls x, ls y LEFT JOIN c ON c.a = x.k AND c.p = y.k""", table)


def classification_report(table: str = "scored_multi") -> str:
    return wrap(f"""WITH {_per_class(table)}
SELECT k AS label, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f1, 4) AS f1,
       CAST(sup AS BIGINT) AS support FROM m2
UNION ALL SELECT 'macro avg', round(avg(pr), 4), round(avg(rc), 4), round(avg(f1), 4), CAST(sum(sup) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(pr * sup) / sum(sup), 4), round(sum(rc * sup) / sum(sup), 4),
                 round(sum(f1 * sup) / sum(sup), 4), CAST(sum(sup) AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(sup), 4), CAST(sum(sup) AS BIGINT) FROM m2""", table)


def regression_scores(table: str = "scored_regression", pred: str = "prediction") -> str:
    return wrap(f"""
SELECT round(mae, 4) AS mae, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse,
       round(CASE WHEN vy > 0 THEN 1 - mse / vy WHEN mse = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2,
       explained_variance, median_absolute_error, mape
FROM (SELECT avg(abs(e)) AS mae,
             avg(e * e) AS mse, var_pop(y) AS vy,
       round(CASE WHEN var_pop(y) > 0 THEN 1 - var_pop(e) / var_pop(y) WHEN var_pop(e) = 0 THEN 1.0 ELSE 0.0 END, 4)
         AS explained_variance,
       round(quantile_cont(abs(e), 0.5), 4) AS median_absolute_error,
       round(avg(abs(e) / greatest(abs(y), {EPS})) * 100, 2) AS mape
FROM (SELECT CAST(label AS DOUBLE) AS y, CAST({pred} AS DOUBLE) AS p, CAST(label AS DOUBLE) - CAST({pred} AS DOUBLE) AS e
      FROM {table}))""", table)


def evaluate_binary(table: str = "scored_binary") -> str:
    return wrap(f"""SELECT s.*, a.roc_auc, l.log_loss FROM ({classification_scores(table)}) s,
  (SELECT round(auc, 4) AS roc_auc FROM {_auc(table, 'score', 'CASE WHEN label = 1 THEN 1 ELSE 0 END')}) a,
  ({binary_log_loss(table)}) l""", table)


LEADER_MODELS = {
    "scored": "prediction",
    "inflated": "label * 1.05",
    "mean_baseline": "(SELECT avg(label) FROM scored_regression)",
}


def metric_leaderboard() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS model, * FROM ({regression_scores('scored_regression', expr)})"
        for name, expr in LEADER_MODELS.items())
    return wrap(f"SELECT *, CAST(row_number() OVER (ORDER BY r2 DESC NULLS LAST, model) AS INT) AS rank FROM ({parts})",
                "scored_regression")


def roc_curve_points(table: str = "scored_binary") -> str:
    return wrap(f"""
SELECT s AS threshold, round(fps / (n - p), 6) AS fpr, round(tps / p, 6) AS tpr
FROM (SELECT s, sum(cnt) OVER w - sum(npos) OVER w AS fps, sum(npos) OVER w AS tps,
             sum(cnt) OVER () AS n, sum(npos) OVER () AS p
      FROM (SELECT CAST(score AS DOUBLE) AS s, count(*) AS cnt, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos
            FROM {table} GROUP BY 1)
      WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", table)


def residual_histogram(table: str = "scored_regression") -> str:
    def edge(i):
        return f"(CASE WHEN {i} >= 30 THEN s.hi ELSE s.lo + ({i}) * s.step END)"
    return wrap(f"""
WITH r AS (SELECT CAST(label AS DOUBLE) - CAST(prediction AS DOUBLE) AS v FROM {table}),
s0 AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM r WHERE v IS NOT NULL),
s AS (SELECT lo, hi, (hi - lo) / 30 AS step FROM s0),
a AS (SELECT r.v, least(greatest(CAST(floor((r.v - s.lo) * 30 / (s.hi - s.lo)) AS INT), 0), 29) AS i0, s.*
      FROM r, s WHERE r.v IS NOT NULL),
b AS (SELECT *, CASE WHEN v < (CASE WHEN i0 >= 30 THEN hi ELSE lo + i0 * step END) THEN i0 - 1 ELSE i0 END AS i1 FROM a),
c AS (SELECT CASE WHEN i1 < 29 AND v >= (CASE WHEN i1 + 1 >= 30 THEN hi ELSE lo + (i1 + 1) * step END)
                  THEN i1 + 1 ELSE i1 END AS bin FROM b),
counts AS (SELECT bin, count(*) AS cnt FROM c GROUP BY 1)
SELECT 'residual' AS "column", CAST(g.bin AS INT) AS bin, round({edge('g.bin')}, 6) AS lower_edge,
       round({edge('g.bin + 1')}, 6) AS upper_edge, round(({edge('g.bin')} + {edge('g.bin + 1')}) / 2, 6) AS center,
       CAST(COALESCE(counts.cnt, 0) AS BIGINT) AS count
FROM s, range(0, 30) g(bin) LEFT JOIN counts ON counts.bin = g.bin""", table)
