"""Oracle SQL for the exploratory-analysis family."""

from __future__ import annotations

from checks.oracle import (
    SCHEMAS, _column_counts, _overview_body, classes_sub, num_cols, order_key, parse_ts, qi, render, union, wrap,
)


def eda_overview(table: str) -> str:
    return wrap(f"""
SELECT cc."column", cc.position, cc.dtype, CAST(cc.missing_count AS BIGINT) AS missing,
       CASE WHEN cc.n_rows > 0 THEN round(cc.missing_count / cc.n_rows * 100, 2) ELSE 0.0 END AS missing_pct,
       cl.class, CAST(ov.n_rows AS BIGINT) AS n_rows, CAST({len(SCHEMAS[table])} AS BIGINT) AS n_cols,
       CAST(ov.dup_rows AS BIGINT) AS duplicate_rows,
       CASE WHEN ov.n_rows > 0 THEN round(ov.dup_rows / ov.n_rows * 100, 2) ELSE 0.0 END AS duplicate_rows_pct,
       CAST(ov.missing_cells AS BIGINT) AS total_missing, ov.missing_pct AS total_missing_pct
FROM {_column_counts(table)} cc JOIN {classes_sub(table)} cl USING ("column"), {_overview_body(table)} ov""", table)


def _desc_row(table: str, col: str, pos: int, d: int = 6) -> str:
    c = f"CAST({qi(col)} AS DOUBLE)"
    mode = f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return f"""
SELECT '{col}' AS "column", {pos} AS position, count({c}) AS count, round(avg({c}), {d}) AS mean,
       round(quantile_cont({c}, 0.5), {d}) AS median, round({mode}, {d}) AS mode, round(stddev_samp({c}), {d}) AS std,
       round(var_samp({c}), {d}) AS variance, round(min({c}), {d}) AS min, round(max({c}), {d}) AS max,
       round(max({c}) - min({c}), {d}) AS range, round(quantile_cont({c}, 0.25), {d}) AS q1,
       round(quantile_cont({c}, 0.75), {d}) AS q3,
       round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), {d}) AS iqr,
       round(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END, {d}) AS skewness,
       round(CASE WHEN count({c}) < 4 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE kurtosis({c}) END, {d}) AS kurtosis,
       round(CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) * 100 END, {d}) AS cv
FROM {table} HAVING count({c}) > 0"""


def descriptive_stats(table: str) -> str:
    names = [c for c, _ in SCHEMAS[table]]
    return wrap(union([_desc_row(table, c, names.index(c)) for c in num_cols(table)]), table)


def shape_labels(table: str) -> str:
    body = union([_desc_row(table, c, 0) for c in num_cols(table)])
    return wrap(f"""
SELECT "column", skewness, kurtosis,
  CASE WHEN skewness IS NULL THEN 'unknown' WHEN abs(skewness) < 0.5 THEN 'symmetric'
       WHEN abs(skewness) < 1.0 THEN 'moderately skewed' ELSE 'highly skewed' END AS skew_label,
  CASE WHEN kurtosis IS NULL THEN 'unknown' WHEN kurtosis > 1 THEN 'heavy-tailed'
       WHEN kurtosis < -1 THEN 'light-tailed' ELSE 'normal-tailed' END AS kurt_label
FROM ({body})""", table)


def _eda_fence_rows(table: str) -> str:
    parts = []
    for c in num_cols(table):
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS "column", n, CASE WHEN q3 = q1 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END AS lo,
       CASE WHEN q3 = q1 THEN q3 ELSE q3 + 1.5 * (q3 - q1) END AS hi
FROM (SELECT count({x}) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})
WHERE n >= 4""")
    return "(" + union(parts) + ")"


def eda_outliers(table: str) -> str:
    parts = []
    for c in num_cols(table):
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT f."column", CAST((SELECT count(*) FROM {table} WHERE {x} < f.lo OR {x} > f.hi) AS BIGINT) AS count,
       f.n, f.lo, f.hi FROM {_eda_fence_rows(table)} f WHERE f."column" = '{c}'""")
    return wrap(f"""
SELECT "column", count, round(count / n * 100, 2) AS pct, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound
FROM ({union(parts)})""", table)


def _samples(table: str, key: str) -> str:
    parts = []
    for c in num_cols(table):
        if c == key:
            continue
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY t.{qi(key)}) AS INT) AS rank, t.{qi(key)} AS key,
       round({x}, 6) AS value
FROM {table} t, {_eda_fence_rows(table)} f
WHERE f."column" = '{c}' AND ({x} < f.lo OR {x} > f.hi) QUALIFY rank <= 10""")
    return union(parts)


def outlier_samples(table: str, key: str) -> str:
    return wrap(_samples(table, key), table)


def outlier_rows(table: str, key: str) -> str:
    cols = ", ".join(f"t.{qi(c)}" for c, _ in SCHEMAS[table])
    return wrap(f"SELECT s.\"column\" AS flag_column, {cols} FROM {table} t JOIN ({_samples(table, key)}) s "
                f"ON t.{qi(key)} = s.key", table)


def _pair(a: str, b: str) -> str:
    f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"CASE WHEN stddev_pop({a}) {f} * stddev_pop({b}) {f} <> 0 THEN "
            f"covar_pop({a}, {b}) {f} / (stddev_pop({a}) {f} * stddev_pop({b}) {f}) END")


def _diag(table: str, cols: list[str]) -> list[str]:
    return [f"SELECT '{c}' AS col_a, '{c}' AS col_b, {i} AS i, {i} AS j, "
            f"CASE WHEN count({qi(c)}) > 1 AND var_pop(CAST({qi(c)} AS DOUBLE)) > 0 THEN 1.0 END AS r FROM {table}"
            for i, c in enumerate(cols)]


def pearson_matrix(table: str) -> str:
    cols = num_cols(table)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                continue
            x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, {_pair(x, y)} AS r FROM {table}")
    parts += _diag(table, cols)
    return wrap(f"SELECT col_a, col_b, i, j, round(r, 6) AS r FROM ({union(parts)})", table)


def _spearman_pair(table: str, a: str, b: str) -> str:
    x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
    ranked = (f"SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra, "
              f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb "
              f"FROM (SELECT {x} AS x, {y} AS y FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)")
    return f"SELECT {_pair('ra', 'rb')} AS r FROM ({ranked})"


def spearman_matrix(table: str) -> str:
    cols = num_cols(table)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, r FROM ({_spearman_pair(table, a, b)})")
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {j} AS i, {i} AS j, r FROM ({_spearman_pair(table, a, b)})")
    parts += _diag(table, cols)
    return wrap(f"SELECT col_a, col_b, i, j, round(r, 6) AS r FROM ({union(parts)})", table)


def top_correlations(table: str) -> str:
    m = pearson_matrix(table)
    return f"""
SELECT CAST(row_number() OVER (ORDER BY abs(round(r, 4)) DESC, i, j) AS INT) AS rank, col_a, col_b,
       round(r, 4) AS pearson,
       CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({m}) WHERE i < j AND r IS NOT NULL QUALIFY rank <= 10"""


def histograms(table: str) -> str:
    parts = []
    for c in num_cols(table):
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS "column", CAST(least(50, greatest(10, floor(sqrt(count({x}))))) AS INT) AS nb,
       CASE WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS lo,
       CASE WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END AS hi
FROM {table} HAVING count({x}) >= 2""")
    spec = f"(SELECT *, (hi - lo) / nb AS step FROM ({union(parts)}))"
    vals = union([f"SELECT '{c}' AS \"column\", CAST({qi(c)} AS DOUBLE) AS v FROM {table} WHERE {qi(c)} IS NOT NULL"
                  for c in num_cols(table)])

    def edge(i):
        return f"(CASE WHEN {i} >= s.nb THEN s.hi ELSE s.lo + ({i}) * s.step END)"
    i0 = "least(greatest(CAST(floor((v.v - s.lo) * s.nb / (s.hi - s.lo)) AS INT), 0), s.nb - 1)"
    return wrap(f"""
WITH s AS {spec},
a AS (SELECT v."column", v.v, s.nb, s.lo, s.hi, s.step, {i0} AS i0 FROM ({vals}) v JOIN s USING ("column")),
b AS (SELECT *, CASE WHEN v < (CASE WHEN i0 >= nb THEN hi ELSE lo + i0 * step END) THEN i0 - 1 ELSE i0 END AS i1 FROM a),
c AS (SELECT *, CASE WHEN i1 < nb - 1 AND v >= (CASE WHEN i1 + 1 >= nb THEN hi ELSE lo + (i1 + 1) * step END)
                     THEN i1 + 1 ELSE i1 END AS bin FROM b),
counts AS (SELECT "column", bin, count(*) AS cnt FROM c GROUP BY ALL),
grid AS (SELECT s.*, CAST(g.bin AS INT) AS bin FROM s, range(0, 50) g(bin) WHERE g.bin < s.nb)
SELECT s."column", s.bin, round({edge('s.bin')}, 6) AS lower_edge, round({edge('s.bin + 1')}, 6) AS upper_edge,
       round(({edge('s.bin')} + {edge('s.bin + 1')}) / 2, 6) AS center, CAST(COALESCE(counts.cnt, 0) AS BIGINT) AS count
FROM grid s LEFT JOIN counts ON s."column" = counts."column" AND s.bin = counts.bin""", table)


def categorical_breakdown(table: str, cols: list[str]) -> str:
    types = dict(SCHEMAS[table])
    parts = []
    for c in cols:
        t = types[c]
        parts.append(f"""
SELECT '{c}' AS "column",
       CAST(row_number() OVER (ORDER BY cnt DESC, ({qi(c)} IS NULL), {order_key(c, t)}) AS INT) AS rank,
       CASE WHEN {qi(c)} IS NULL THEN '(missing)' ELSE {render(c, t)} END AS label, CAST(cnt AS BIGINT) AS count,
       round(cnt / (SELECT count(*) FROM {table}) * 100, 2) AS pct,
       CAST((SELECT count(DISTINCT {qi(c)}) FROM {table}) AS BIGINT) AS n_unique
FROM (SELECT {qi(c)}, count(*) AS cnt FROM {table} GROUP BY ALL) d QUALIFY rank <= 15""")
    return wrap(union(parts), table)


def monthly_totals(table: str, date_col: str, value_col: str) -> str:
    return wrap(f"""
SELECT '{date_col}' AS date_column, '{value_col}' AS value_column, strftime({qi(date_col)}, '%Y-%m') AS period,
       COALESCE(sum(CAST({qi(value_col)} AS DOUBLE)), 0.0) AS value
FROM {table} WHERE {qi(date_col)} IS NOT NULL GROUP BY 3""", table)


def monthly_moving_avg(table: str, date_col: str, value_col: str) -> str:
    return f"""
SELECT date_column, value_column, period, round(value, 6) AS value,
       round(avg(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg
FROM ({monthly_totals(table, date_col, value_col)})"""


def weekly_totals(table: str, date_col: str, value_col: str) -> str:
    return wrap(f"""
SELECT '{date_col}' AS date_column, '{value_col}' AS value_column,
       strftime(wk, '%Y-%m-%d') || '/' || strftime(wk + INTERVAL 6 DAY, '%Y-%m-%d') AS period, round(value, 6) AS value
FROM (SELECT CAST(date_trunc('week', {qi(date_col)}) AS DATE) AS wk,
             COALESCE(sum(CAST({qi(value_col)} AS DOUBLE)), 0.0) AS value
      FROM {table} WHERE {qi(date_col)} IS NOT NULL GROUP BY 1)
ORDER BY wk LIMIT 52""", table)


def missing_ranking(table: str) -> str:
    return wrap(f"""
SELECT "column", CAST(missing_count AS BIGINT) AS missing,
       round(missing_count / n_rows * 100, 2) AS missing_pct,
       CAST(row_number() OVER (ORDER BY round(missing_count / n_rows * 100, 2) DESC, position) AS INT) AS rank
FROM {_column_counts(table)} WHERE missing_count > 0""", table)


def box_plot_stats(table: str) -> str:
    parts = []
    for c in num_cols(table):
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS "column", round(f.q1, 6) AS q1, round(f.med, 6) AS median, round(f.q3, 6) AS q3,
       round((SELECT min({x}) FROM {table} WHERE {x} >= f.lo AND {x} <= f.hi), 6) AS lower_whisker,
       round((SELECT max({x}) FROM {table} WHERE {x} >= f.lo AND {x} <= f.hi), 6) AS upper_whisker,
       CAST((SELECT count(*) FROM {table} WHERE {x} < f.lo OR {x} > f.hi) AS BIGINT) AS n_outliers
FROM (SELECT q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3
            FROM {table})) f""")
    return wrap(union(parts), table)


def ols_trend(table: str, x: str, y: str) -> str:
    xs, ys = f"CAST({qi(x)} AS DOUBLE)", f"CAST({qi(y)} AS DOUBLE)"
    return wrap(f"""
SELECT '{x}' AS x, '{y}' AS y, round(regr_slope({ys}, {xs}), 6) AS slope, round(regr_intercept({ys}, {xs}), 6) AS intercept,
       round(regr_r2({ys}, {xs}), 6) AS r2, CAST(regr_count({ys}, {xs}) AS BIGINT) AS n FROM {table}""", table)


def insights(table: str, cat_cols: list[str]) -> str:
    names = [c for c, _ in SCHEMAS[table]]
    desc = union([_desc_row(table, c, names.index(c)) for c in num_cols(table)])
    outl = eda_outliers(table)
    cats = categorical_breakdown(table, cat_cols)
    top = top_correlations(table)
    return wrap(f"""
SELECT CASE WHEN dup_rows = 0 THEN 'no_duplicates' ELSE 'duplicates' END AS rule, CAST(NULL AS VARCHAR) AS "column",
       CAST(dup_rows AS DOUBLE) AS value FROM {_overview_body(table)} o1
UNION ALL
SELECT CASE WHEN missing_cells = 0 THEN 'complete' ELSE 'missing' END, NULL, CAST(missing_cells AS DOUBLE)
FROM {_overview_body(table)} o2
UNION ALL
SELECT 'outliers', "column", CAST(count AS DOUBLE) FROM ({outl}) WHERE count > 0
UNION ALL
SELECT CASE WHEN skewness > 0 THEN 'skewed_right' ELSE 'skewed_left' END, "column", skewness
FROM ({desc}) WHERE abs(skewness) > 1
UNION ALL
SELECT 'strong_' || direction, col_a || '|' || col_b, pearson FROM ({top}) WHERE rank <= 3 AND abs(pearson) > 0.7
UNION ALL
SELECT 'high_cardinality', "column", CAST(n_unique AS DOUBLE) FROM ({cats}) WHERE rank = 1 AND n_unique > 50
UNION ALL
SELECT 'dominant_value', "column", pct FROM ({cats}) WHERE rank = 1 AND pct > 70""", table)


def pick_value_column(value: str) -> str:
    return f"SELECT '{value}' AS value_column"


_ = parse_ts
