"""Oracle SQL for the exactly specified learners (Gaussian NB, KNN, one-feature OLS, class weights)."""

from __future__ import annotations

from checks.oracle_prepare import bucket

SPLIT = f"{bucket('vec_id')} < 2000"


def _emb(where: str) -> str:
    return f"(SELECT vec_id, label, embedding FROM embeddings WHERE {where})"


def gaussian_nb() -> str:
    return f"""
WITH train AS {_emb('NOT (' + SPLIT + ')')}, test AS {_emb(SPLIT)},
tv AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM train),
eps AS (SELECT 1e-9 * max(vp) AS e FROM (SELECT i, var_pop(v) AS vp FROM tv GROUP BY i)),
stats AS (SELECT label, i, avg(v) AS mu, var_pop(v) + (SELECT e FROM eps) AS var FROM tv GROUP BY label, i),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM train)) AS lp FROM train GROUP BY label),
qv AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM test),
jll AS (SELECT q.vec_id, s.label, sum(-0.5 * ln(2 * pi() * s.var) - (q.v - s.mu) * (q.v - s.mu) / (2 * s.var)) AS ll
        FROM qv q JOIN stats s USING (i) GROUP BY q.vec_id, s.label)
SELECT vec_id, CAST(label AS INT) AS prediction FROM (
  SELECT j.vec_id, j.label, row_number() OVER (PARTITION BY j.vec_id ORDER BY j.ll + p.lp DESC, j.label) AS r
  FROM jll j JOIN prior p USING (label)) WHERE r = 1"""


def knn_classify(k: int = 5) -> str:
    return f"""
WITH train AS {_emb('NOT (' + SPLIT + ')')}, test AS {_emb(SPLIT)},
d AS (SELECT q.vec_id, t.label,
             sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])),
                                          lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
      FROM test q, train t),
nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist) <= {k})
SELECT vec_id, CAST(label AS INT) AS prediction FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS r
  FROM nn GROUP BY vec_id, label) WHERE r = 1"""


def linear_regression() -> str:
    return ("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, "
            "round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem")


def balanced_class_weights() -> str:
    return """
SELECT o_orderstatus, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 6)
       AS class_weight
FROM orders GROUP BY o_orderstatus"""
