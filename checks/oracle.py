"""DuckDB oracle SQL for every SQL-checkable query in ``__spark_entry__``.

Written against the SQL definitions of the operators (pandas semantics as read
from the reference), not against the Spark code. Per-column work is spelled
out as one SELECT per column joined with UNION ALL.
"""

from __future__ import annotations

from checks.views import with_views

# Schemas of the inputs used below (name, Spark simple type).
SCHEMAS = {
    "dirty": [("o_orderkey", "bigint"), ("amount", "double"), ("priority", "string"), ("cust_txt", "string"),
              ("date_txt", "string"), ("is_final", "boolean"), ("const_one", "int"), ("mostly_null", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "fe_input": [("order_id", "bigint"), ("order_date", "string"), ("total_price", "double"),
                 ("price_double", "double"), ("status", "string"), ("priority", "string"), ("acct_balance", "double"),
                 ("segment", "string"), ("customer_name", "string"), ("is_final", "boolean"), ("nation", "int"),
                 ("discount_rate", "double"), ("const_txt", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
}
NUMERIC = {"bigint", "int", "double", "smallint", "tinyint", "float"}
INTEGRAL = {"bigint", "int", "smallint", "tinyint"}
VIEW_TABLES = {"dirty", "scored_binary", "scored_multi", "scored_regression", "scored_proba", "fe_input"}

# The timestamp formats accepted when parsing strings (strftime form).
DATE_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S.%f",
                "%Y-%m-%dT%H:%M:%S.%f", "%d-%m-%Y", "%d %b %Y", "%b %d, %Y", "%Y-%m"]


def parse_ts(expr: str) -> str:
    return "COALESCE(" + ", ".join(f"try_strptime(trim({expr}), '{f}')" for f in DATE_FORMATS) + ")"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def views_for(table: str) -> tuple[str, ...]:
    return (table,) if table in VIEW_TABLES else ()


def wrap(sql: str, *tables: str) -> str:
    names = []
    for t in tables:
        names += [v for v in views_for(t) if v not in names]
    return with_views(sql, *names)


def num_cols(table: str) -> list[str]:
    return [c for c, t in SCHEMAS[table] if t in NUMERIC]


def render(col: str, typ: str) -> str:
    """Display form of a value (matches the library's VF rendering)."""
    c = qi(col)
    if typ in ("double", "float"):
        return f"printf('%.4f', {c})"
    if typ.startswith("timestamp"):
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({c} AS VARCHAR)"


def order_key(col: str, typ: str) -> str:
    c = qi(col)
    if typ in NUMERIC:
        return f"CAST({c} AS DOUBLE) NULLS LAST, NULL"
    if typ.startswith("timestamp"):
        return f"NULL, strftime({c}, '%Y-%m-%d %H:%M:%S')"
    return f"NULL, CAST({c} AS VARCHAR)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- profiling

def profile_overview(table: str) -> str:
    cols = [c for c, _ in SCHEMAS[table]]
    nulls = " + ".join(f"CASE WHEN {qi(c)} IS NULL THEN 1 ELSE 0 END" for c in cols)
    n = len(cols)
    return wrap(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({n} AS BIGINT) AS n_cols,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS BIGINT) AS dup_rows,
       CAST(COALESCE(sum({nulls}), 0) AS BIGINT) AS missing_cells,
       CASE WHEN count(*) > 0 THEN round(COALESCE(sum({nulls}), 0) / (count(*) * {n}) * 100, 2) ELSE 0.0 END
         AS missing_pct
FROM {table}""", table)


def _string_class(table: str, col: str, pos: int) -> str:
    c = qi(col)
    return f"""
SELECT '{col}' AS "column", {pos} AS position, 'string' AS dtype,
       CASE WHEN s.bad = 0 THEN 'datetime'
            WHEN s.avg_len > 40 OR u.n_unique / GREATEST(u.n_rows, 1) > 0.85 THEN 'text'
            ELSE 'categorical' END AS class
FROM (SELECT count(*) FILTER (WHERE {parse_ts('x')} IS NULL) AS bad, avg(length(x)) AS avg_len
      FROM (SELECT {c} AS x FROM {table} WHERE {c} IS NOT NULL ORDER BY md5({c}), {c} LIMIT 50)) s,
     (SELECT count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM {table}) u"""


def classify_columns(table: str) -> str:
    parts = []
    for i, (c, t) in enumerate(SCHEMAS[table]):
        if t == "string":
            parts.append(_string_class(table, c, i))
        else:
            cls = "numeric" if t in NUMERIC else ("datetime" if t.startswith("timestamp") or t == "date" else "categorical")
            parts.append(f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, '{cls}' AS class")
    return wrap(union(parts), table)


def classes(table: str) -> str:
    """Subquery text ``(column, position, dtype, class)``."""
    return "(" + classify_columns(table).split("\n", 1)[1] + ")" if table in VIEW_TABLES else "(" + classify_columns(table) + ")"


def sample_values(table: str, k: int = 4) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        parts.append(f"""
SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY {order_key(c, t)}) AS INT) AS rank, v AS value
FROM (SELECT DISTINCT {qi(c)}, {render(c, t)} AS v FROM {table} WHERE {qi(c)} IS NOT NULL) d
QUALIFY rank <= {k}""")
    return wrap(union(parts), table)


def _skew(c: str) -> str:
    return (f"CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END")


def _kurt(c: str) -> str:
    return (f"CASE WHEN count({c}) < 4 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE kurtosis({c}) END")


def _numeric_row(table: str, col: str, pos: int) -> str:
    c = f"CAST({qi(col)} AS DOUBLE)"
    return f"""
SELECT '{col}' AS "column", {pos} AS position, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
       var_samp({c}) AS var, min({c}) AS min, max({c}) AS max,
       quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3,
       {_skew(c)} AS skew, {_kurt(c)} AS kurt, sum({c}) AS total
FROM {table}"""


def numeric_stats(table: str, cols: list[str] | None = None) -> str:
    """Subquery of raw numeric stats per column (no outliers)."""
    names = [c for c, _ in SCHEMAS[table]]
    cols = cols or num_cols(table)
    return "(" + union([_numeric_row(table, c, names.index(c)) for c in cols]) + ")"


def _outliers(table: str, col: str, zero_iqr: str = "none", factor: float = 1.5) -> str:
    c = f"CAST({qi(col)} AS DOUBLE)"
    lo = f"q1 - {factor} * (q3 - q1)"
    hi = f"q3 + {factor} * (q3 - q1)"
    if zero_iqr == "collapse":
        lo = f"CASE WHEN q3 = q1 THEN q1 ELSE {lo} END"
        hi = f"CASE WHEN q3 = q1 THEN q3 ELSE {hi} END"
    return f"""
SELECT '{col}' AS "column", f.q1, f.q3, f.lower, f.upper,
       (SELECT count(*) FROM {table} WHERE {c} < f.lower OR {c} > f.upper) AS outliers,
       (SELECT count({c}) FROM {table}) AS n
FROM (SELECT q1, q3, {lo} AS lower, {hi} AS upper
      FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})) f"""


def outlier_table(table: str, cols: list[str] | None = None, zero_iqr: str = "none", factor: float = 1.5) -> str:
    cols = cols or num_cols(table)
    return "(" + union([_outliers(table, c, zero_iqr, factor) for c in cols]) + ")"


def profile_numeric(table: str) -> str:
    return wrap(f"""
SELECT s."column", s.position, round(s.mean, 4) AS mean, round(s.median, 4) AS median, round(s.std, 4) AS std,
       round(s.min, 4) AS min, round(s.max, 4) AS max, round(s.q1, 4) AS q1, round(s.q3, 4) AS q3,
       round(s.skew, 4) AS skewness, CAST(o.outliers AS BIGINT) AS outliers
FROM {numeric_stats(table)} s JOIN {outlier_table(table)} o USING ("column")
WHERE s.n > 0""", table)


def iqr_outlier_count(table: str) -> str:
    return wrap(f"""
SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper,
       CAST(outliers AS BIGINT) AS outliers
FROM {outlier_table(table)} o WHERE q1 IS NOT NULL""", table)


def top_values(table: str, cols: list[str], k: int = 5) -> str:
    types = dict(SCHEMAS[table])
    parts = []
    for c in cols:
        t = types[c]
        parts.append(f"""
SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY cnt DESC, {order_key(c, t)}) AS INT) AS rank,
       v AS value, CAST(cnt AS BIGINT) AS count, round(cnt / (SELECT count(*) FROM {table}) * 100, 1) AS pct,
       CAST((SELECT count(DISTINCT {qi(c)}) FROM {table}) AS BIGINT) AS n_unique
FROM (SELECT {qi(c)}, {render(c, t)} AS v, count(*) AS cnt FROM {table} WHERE {qi(c)} IS NOT NULL GROUP BY ALL) d
QUALIFY rank <= {k}""")
    return wrap(union(parts), table)


def _column_counts(table: str) -> str:
    parts = []
    for i, (c, t) in enumerate(SCHEMAS[table]):
        parts.append(f"""
SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, count(*) FILTER (WHERE {qi(c)} IS NULL) AS missing_count,
       count(DISTINCT {qi(c)}) AS n_unique, count(*) AS n_rows FROM {table}""")
    return "(" + union(parts) + ")"


def profile_columns(table: str) -> str:
    return wrap(f"""
SELECT "column", position, dtype, CAST(missing_count AS BIGINT) AS missing_count,
       CASE WHEN n_rows > 0 THEN round(missing_count / n_rows * 100, 2) ELSE 0.0 END AS missing_pct,
       CAST(n_unique AS BIGINT) AS n_unique
FROM {_column_counts(table)}""", table)


def facts(table: str) -> str:
    """Subquery: column facts (counts, class, outliers, skewness)."""
    numeric = [c for c in num_cols(table)]
    stats = (f"(SELECT s.\"column\", round(s.skew, 4) AS skewness, o.outliers FROM {numeric_stats(table, numeric)} s "
             f"JOIN {outlier_table(table, numeric)} o USING (\"column\") WHERE s.n > 0)") if numeric else \
        "(SELECT NULL AS \"column\", NULL AS skewness, NULL AS outliers WHERE false)"
    return f"""(
SELECT cc."column", cc.position, cc.dtype, cl.class, cc.missing_count,
       CASE WHEN cc.n_rows > 0 THEN round(cc.missing_count / cc.n_rows * 100, 2) ELSE 0.0 END AS missing_pct,
       cc.n_unique, cc.n_rows, ns.outliers, ns.skewness
FROM {_column_counts(table)} cc
JOIN {classes_sub(table)} cl USING ("column")
LEFT JOIN {stats} ns USING ("column"))"""


def classes_sub(table: str) -> str:
    parts = []
    for i, (c, t) in enumerate(SCHEMAS[table]):
        if t == "string":
            parts.append(_string_class(table, c, i))
        else:
            cls = "numeric" if t in NUMERIC else ("datetime" if t.startswith("timestamp") or t == "date" else "categorical")
            parts.append(f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, '{cls}' AS class")
    return "(" + union(parts) + ")"


def column_recommendation(table: str) -> str:
    return wrap(f"""
SELECT "column", position,
  CASE WHEN missing_pct > 50 THEN 'drop_column'
       WHEN missing_pct > 10 AND class = 'numeric' THEN 'fill_median'
       WHEN missing_pct > 10 AND class = 'categorical' THEN 'fill_mode'
       WHEN missing_pct > 0 AND class = 'numeric' THEN 'fill_mean_or_median'
       WHEN class = 'numeric' AND COALESCE(outliers, 0) > 0 THEN 'review_outliers'
       WHEN class = 'numeric' AND abs(COALESCE(skewness, 0)) > 1 THEN 'log_transform'
       WHEN class = 'numeric' THEN 'clean'
       WHEN class = 'categorical' AND n_unique = n_rows THEN 'id_like'
       WHEN class = 'categorical' AND n_unique <= 2 THEN 'binary'
       WHEN class = 'categorical' AND n_unique > 50 THEN 'high_cardinality'
       WHEN class = 'categorical' THEN 'ok_cardinality'
       WHEN class = 'datetime' THEN 'extract_datetime_parts'
       WHEN class = 'text' THEN 'text_features'
       ELSE 'no_issues' END AS rule
FROM {facts(table)} f""", table)


def _overview_sub(table: str) -> str:
    return "(" + profile_overview(table).split("\n", 1)[1] + ")" if table in VIEW_TABLES else "(" + profile_overview(table) + ")"


def _overview_body(table: str) -> str:
    cols = [c for c, _ in SCHEMAS[table]]
    nulls = " + ".join(f"CASE WHEN {qi(c)} IS NULL THEN 1 ELSE 0 END" for c in cols)
    n = len(cols)
    return f"""(
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS dup_rows,
       COALESCE(sum({nulls}), 0) AS missing_cells,
       CASE WHEN count(*) > 0 THEN round(COALESCE(sum({nulls}), 0) / (count(*) * {n}) * 100, 2) ELSE 0.0 END
         AS missing_pct
FROM {table})"""


def quality_score(table: str) -> str:
    return wrap(f"""
WITH f AS {facts(table)}, ov AS {_overview_body(table)},
pc AS (SELECT count(*) FILTER (WHERE class = 'numeric') AS numeric_cols,
              count(*) FILTER (WHERE class = 'numeric' AND COALESCE(outliers, 0) > 0) AS affected_cols,
              COALESCE(sum(CASE WHEN class = 'numeric' AND COALESCE(outliers, 0) > 0
                           THEN outliers / n_rows ELSE 0.0 END), 0.0) AS severity,
              count(*) FILTER (WHERE dtype = 'string' AND class = 'text') AS text_cols,
              count(*) FILTER (WHERE n_unique <= 1) AS constant_cols FROM f),
p AS (SELECT least(ov.missing_pct * 1.5, 40.0) AS missing_penalty,
             least(ov.dup_rows / greatest(ov.n_rows, 1) * 100 * 0.5, 20.0) AS duplicate_penalty,
             least(CASE WHEN numeric_cols > 0 THEN affected_cols / numeric_cols ELSE 0.0 END * 10
                   + CASE WHEN numeric_cols > 0 AND affected_cols > 0 THEN severity / affected_cols ELSE 0.0 END * 10,
                   20.0) AS outlier_penalty,
             least(CAST(text_cols * 2 AS DOUBLE), 10.0) AS datatype_penalty,
             least(CAST(constant_cols * 2 AS DOUBLE), 10.0) AS constant_penalty
      FROM ov, pc),
s AS (SELECT *, greatest(0.0, round(100.0 - missing_penalty - duplicate_penalty - outlier_penalty
                                     - datatype_penalty - constant_penalty, 1)) AS score FROM p)
SELECT round(missing_penalty, 2) AS missing_penalty, round(duplicate_penalty, 2) AS duplicate_penalty,
       round(outlier_penalty, 2) AS outlier_penalty, round(datatype_penalty, 2) AS datatype_penalty,
       round(constant_penalty, 2) AS constant_penalty, score,
       CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C'
            WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade
FROM s""", table)


def class_counts(table: str) -> str:
    return wrap(f"SELECT class, count(*) AS n_columns FROM {classes_sub(table)} c GROUP BY class", table)


def target_candidates(table: str) -> str:
    return wrap(f"""
SELECT "column", position, reason, n_unique FROM (
  SELECT "column", position, n_unique,
         CASE WHEN class = 'numeric' AND n_unique > 10 THEN 'regression'
              WHEN class = 'categorical' AND n_unique BETWEEN 2 AND 20 THEN 'classification' END AS reason
  FROM {facts(table)} f) WHERE reason IS NOT NULL ORDER BY position LIMIT 6""", table)


def quality_issues(table: str) -> str:
    return wrap(f"""
SELECT CAST(ov.missing_cells AS BIGINT) AS missing_cells, CAST(ov.dup_rows AS BIGINT) AS duplicate_rows,
       COALESCE((SELECT string_agg("column", ',' ORDER BY position) FROM {facts(table)} f WHERE missing_pct > 30), '')
         AS high_missing_cols,
       COALESCE((SELECT string_agg("column", ',' ORDER BY position) FROM {facts(table)} f
                 WHERE n_unique = n_rows AND class = 'categorical'), '') AS id_like_cols,
       (SELECT count(*) FROM {facts(table)} f WHERE COALESCE(outliers, 0) > 0) AS outlier_columns,
       CAST((SELECT COALESCE(sum(COALESCE(outliers, 0)), 0) FROM {facts(table)} f) AS BIGINT) AS total_outliers
FROM {_overview_body(table)} ov""", table)


def issue_columns(table: str, search: str | None = None) -> str:
    cond = f" AND lower(\"column\") LIKE '%{search.lower()}%'" if search else ""
    return wrap(f"""
SELECT "column", position, CAST(missing_count AS BIGINT) AS missing_count,
       CAST(COALESCE(outliers, 0) AS BIGINT) AS outliers,
       (class = 'categorical' AND n_unique = n_rows) AS id_like
FROM {facts(table)} f
WHERE (missing_count > 0 OR COALESCE(outliers, 0) > 0 OR (class = 'categorical' AND n_unique = n_rows)){cond}""",
                table)


# Bytes per value of fixed-width types (mirrors the library's size estimate).
FIXED_WIDTH = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "date": 4, "float": 4,
               "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def size_estimate(table: str) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        if t == "string":
            parts.append(f"SELECT '{c}' AS \"column\", CAST(COALESCE(sum(octet_length(CAST({qi(c)} AS BLOB))), 0) AS BIGINT) AS bytes FROM {table}")
        else:
            parts.append(f"SELECT '{c}' AS \"column\", CAST(count({qi(c)}) * {FIXED_WIDTH.get(t, 8)} AS BIGINT) AS bytes FROM {table}")
    return wrap(union(parts), table)
