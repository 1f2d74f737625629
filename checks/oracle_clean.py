"""Oracle SQL for the cleaning family (detection and application) on the ``dirty`` view."""

from __future__ import annotations

from checks.oracle import facts, parse_ts, qi, union, wrap

DIRTY_COLS = ["o_orderkey", "amount", "priority", "cust_txt", "date_txt", "is_final", "const_one", "mostly_null"]


def _num(expr: str) -> str:
    return f"CASE WHEN NOT isnan(TRY_CAST({expr} AS DOUBLE)) THEN TRY_CAST({expr} AS DOUBLE) END"


def _mode_text(table: str, col: str) -> str:
    return (f"(SELECT CAST({qi(col)} AS VARCHAR) FROM {table} WHERE {qi(col)} IS NOT NULL GROUP BY {qi(col)} "
            f"ORDER BY count(*) DESC, {qi(col)} LIMIT 1)")


def missing_issues(table: str = "dirty") -> str:
    modes = union([f"SELECT '{c}' AS \"column\", {_mode_text(table, c)} AS mode"
                   for c in ["priority", "cust_txt", "date_txt", "is_final", "mostly_null"]])
    meds = union([f"SELECT '{c}' AS \"column\", quantile_cont(CAST({qi(c)} AS DOUBLE), 0.5) AS median FROM {table}"
                  for c in ["o_orderkey", "amount", "const_one"]])
    return wrap(f"""
SELECT f."column", f.position, f.class, CAST(f.missing_count AS BIGINT) AS missing_count, f.missing_pct,
  CASE WHEN missing_pct > 50 THEN 'drop_column'
       WHEN class = 'numeric' THEN CASE WHEN abs(COALESCE(skewness, 0)) > 0.5 THEN 'fill_median' ELSE 'fill_mean' END
       WHEN class = 'categorical' THEN 'fill_mode' ELSE 'fill_constant' END AS recommended_fix,
  CASE WHEN missing_pct > 50 THEN 'drop_column,fill_median,fill_mean,fill_mode,fill_constant'
       WHEN class = 'numeric' THEN 'fill_median,fill_mean,fill_constant,drop_rows'
       WHEN class = 'categorical' THEN 'fill_mode,fill_constant,drop_rows' ELSE 'fill_constant,drop_rows' END
    AS fix_options,
  CASE WHEN missing_pct <= 50 AND class = 'numeric' THEN round(md.median, 4) END AS fill_number,
  CASE WHEN missing_pct > 50 OR class = 'numeric' THEN NULL
       WHEN class = 'categorical' THEN COALESCE(mo.mode, 'Unknown') ELSE 'Unknown' END AS fill_text
FROM {facts(table)} f LEFT JOIN ({meds}) md USING ("column") LEFT JOIN ({modes}) mo USING ("column")
WHERE f.missing_count > 0""", table)


def missing_severity(table: str = "dirty") -> str:
    return wrap(f"""
SELECT "column", missing_pct,
       CASE WHEN missing_pct > 30 THEN 'HIGH' WHEN missing_pct > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM {facts(table)} f WHERE missing_count > 0""", table)


def duplicate_issue(table: str = "dirty") -> str:
    return wrap(f"""
SELECT CAST(n - d AS BIGINT) AS count, CASE WHEN n > 0 THEN round((n - d) / n * 100, 2) END AS pct,
       CASE WHEN n - d > 0 THEN 'drop_duplicates' ELSE 'none' END AS recommended_fix
FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS d FROM {table})""", table)


def outlier_issues(table: str = "dirty", cols=("o_orderkey", "amount", "const_one")) -> str:
    parts = []
    for c in cols:
        x = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS "column", CAST(cnt AS BIGINT) AS count, round(cnt / n * 100, 2) AS pct,
       round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence, round(q1, 4) AS q1, round(q3, 4) AS q3,
       'winsorize' AS recommended_fix, 'winsorize,drop_rows,keep' AS fix_options
FROM (SELECT q1, q3, lo, hi, (SELECT count(*) FROM {table} WHERE {x} < lo OR {x} > hi) AS cnt,
             (SELECT count({x}) FROM {table}) AS n
      FROM (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
            FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})))
WHERE q3 <> q1 AND cnt > 0""")
    return wrap(union(parts), table)


def _type_counts(table: str = "dirty") -> str:
    cols = [("priority", 2), ("cust_txt", 3), ("date_txt", 4), ("mostly_null", 7)]
    return "(" + union([
        f"SELECT '{c}' AS \"column\", count({qi(c)}) AS n_total, count({_num(qi(c))}) AS n_numeric, "
        f"count({parse_ts(qi(c))}) AS n_dates FROM {table}" for c, _ in cols]) + ")"


def numeric_type_issues(table: str = "dirty") -> str:
    return wrap(f"""
SELECT "column", n_numeric AS n_valid, n_total, 'double' AS suggested_dtype, 'convert_numeric' AS action
FROM {_type_counts(table)} t WHERE n_total > 0 AND n_numeric / n_total > 0.9""", table)


def datetime_type_issues(table: str = "dirty") -> str:
    return wrap(f"""
SELECT "column", n_dates AS n_valid, n_total, 'timestamp' AS suggested_dtype, 'convert_datetime' AS action
FROM {_type_counts(table)} t
WHERE NOT (n_total > 0 AND n_numeric / n_total > 0.9) AND n_total > 0 AND n_dates / n_total > 0.9""", table)


def issue_summary(table: str = "dirty") -> str:
    return wrap(f"""
SELECT CAST(m AS BIGINT) AS missing_issues, CAST(d AS BIGINT) AS duplicate_issues, CAST(o AS BIGINT) AS outlier_issues,
       CAST(t AS BIGINT) AS type_issues, CAST(m + d + o + t AS BIGINT) AS total_issues
FROM (SELECT (SELECT count(*) FROM ({missing_issues(table)})) AS m,
             (SELECT CASE WHEN count > 0 THEN 1 ELSE 0 END FROM ({duplicate_issue(table)})) AS d,
             (SELECT count(*) FROM ({outlier_issues(table)})) AS o,
             (SELECT count(*) FROM ({numeric_type_issues(table)}))
             + (SELECT count(*) FROM ({datetime_type_issues(table)})) AS t)""", table)


def _select_with(replace: dict[str, str], drop: tuple = ()) -> str:
    return ", ".join(f"{replace.get(c, qi(c))} AS {qi(c)}" for c in DIRTY_COLS if c not in drop)


def convert_numeric() -> str:
    return wrap(f"SELECT {_select_with({'cust_txt': _num('cust_txt')})} FROM dirty", "dirty")


def convert_datetime() -> str:
    return wrap(f"SELECT {_select_with({'date_txt': parse_ts('date_txt')})} FROM dirty", "dirty")


def fill_median() -> str:
    return wrap(f"SELECT {_select_with({'amount': 'COALESCE(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty))'})} FROM dirty", "dirty")


def fill_mean() -> str:
    return wrap(f"SELECT {_select_with({'amount': 'COALESCE(amount, (SELECT avg(amount) FROM dirty))'})} FROM dirty", "dirty")


def fill_mode() -> str:
    return wrap(f"SELECT {_select_with({'priority': 'COALESCE(priority, ' + _mode_text('dirty', 'priority') + ')'})} FROM dirty", "dirty")


def fill_constant() -> str:
    return wrap(f"SELECT {_select_with({'priority': chr(39) + 'Unknown' + chr(39)})} FROM dirty".replace(
        "'Unknown' AS \"priority\"", "COALESCE(priority, 'Unknown') AS \"priority\""), "dirty")


def drop_column() -> str:
    return wrap(f"SELECT {_select_with({}, drop=('mostly_null',))} FROM dirty", "dirty")


def drop_rows_missing() -> str:
    return wrap("SELECT * FROM dirty WHERE amount IS NOT NULL AND priority IS NOT NULL", "dirty")


def drop_duplicates() -> str:
    return wrap("SELECT DISTINCT * FROM dirty", "dirty")


def _fences(table: str, col: str) -> str:
    return (f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM {table}))")


def winsorize() -> str:
    clip = "CASE WHEN amount < f.lo THEN f.lo WHEN amount > f.hi THEN f.hi ELSE amount END"
    return wrap(f"SELECT {_select_with({'amount': clip})} FROM dirty, {_fences('dirty', 'amount')} f", "dirty")


def drop_outlier_rows() -> str:
    return wrap(f"SELECT dirty.* FROM dirty, {_fences('dirty', 'amount')} f "
                f"WHERE NOT COALESCE(amount < f.lo OR amount > f.hi, false)", "dirty")


# The explicit plan used by the apply_cleaning / cleaning_report queries.
APPLY_PLAN = {
    "types": {"cust_txt": {"action": "convert_numeric"}, "date_txt": {"action": "convert_datetime"}},
    "missing": {"amount": {"action": "fill_median"}, "priority": {"action": "fill_constant", "constant": "MISSING"},
                "mostly_null": {"action": "drop_column"}, "cust_txt": {"action": "drop_rows"},
                "const_one": {"action": "fill_mean"}},
    "duplicates": {"action": "drop_duplicates"},
    "outliers": {"amount": {"action": "drop_rows"}, "o_orderkey": {"action": "winsorize"}},
}


def _apply_ctes() -> str:
    t1 = _select_with({"cust_txt": _num("cust_txt"), "date_txt": parse_ts("date_txt")})
    keep = [c for c in DIRTY_COLS if c != "mostly_null"]
    t2 = ", ".join(
        "COALESCE(amount, (SELECT quantile_cont(amount, 0.5) FROM t1)) AS amount" if c == "amount" else
        "COALESCE(priority, 'MISSING') AS priority" if c == "priority" else qi(c) for c in keep)
    t5 = ", ".join("CASE WHEN o_orderkey < f.lo THEN f.lo WHEN o_orderkey > f.hi THEN f.hi ELSE o_orderkey END "
                   "AS o_orderkey" if c == "o_orderkey" else qi(c) for c in keep)
    return f"""WITH t1 AS (SELECT {t1} FROM dirty),
t2 AS (SELECT {t2} FROM t1 WHERE cust_txt IS NOT NULL),
t3 AS (SELECT DISTINCT * FROM t2),
f1 AS {_fences('t3', 'amount')},
t4 AS (SELECT t3.* FROM t3, f1 WHERE NOT COALESCE(amount < f1.lo OR amount > f1.hi, false)),
f AS {_fences('t4', 'o_orderkey')},
t5 AS (SELECT {t5} FROM t4, f)"""


def apply_cleaning() -> str:
    return wrap(_apply_ctes() + "\nSELECT * FROM t5", "dirty")


def cleaning_report() -> str:
    def fence_text(t, c):
        return (f"(SELECT '[' || CAST(round(lo, 2) AS VARCHAR) || ', ' || CAST(round(hi, 2) AS VARCHAR) || ']' "
                f"FROM {_fences(t, c)})")

    def n_out(t, c):
        return (f"(SELECT count(*) FROM {t}, {_fences(t, c)} f WHERE CAST({c} AS DOUBLE) < f.lo "
                f"OR CAST({c} AS DOUBLE) > f.hi)")

    return wrap(_apply_ctes() + f"""
SELECT * FROM (VALUES
 (1, 'Type Fix', 'cust_txt', 'convert_numeric', 'done', NULL, (SELECT count(cust_txt) FROM t1)),
 (2, 'Type Fix', 'date_txt', 'convert_datetime', 'done', NULL, (SELECT count(date_txt) FROM t1)),
 (3, 'Missing Values', 'amount', 'fill_median', 'filled',
     (SELECT printf('%.4f', quantile_cont(amount, 0.5)) FROM t1), (SELECT count(*) - count(amount) FROM t1)),
 (4, 'Missing Values', 'priority', 'fill_constant', 'filled', 'MISSING', (SELECT count(*) - count(priority) FROM t1)),
 (5, 'Missing Values', 'mostly_null', 'drop_column', 'dropped', NULL, (SELECT count(*) - count(mostly_null) FROM t1)),
 (6, 'Missing Values', 'cust_txt', 'drop_rows', 'flagged', NULL, (SELECT count(*) - count(cust_txt) FROM t1)),
 (7, 'Missing Values', '(multiple)', 'drop_rows', 'removed', NULL, (SELECT count(*) - count(cust_txt) FROM t1)),
 (8, 'Duplicates', '-', 'drop_duplicates', 'removed', NULL, (SELECT count(*) FROM t2) - (SELECT count(*) FROM t3)),
 (9, 'Outliers', 'amount', 'drop_rows', 'done', {fence_text('t3', 'amount')}, {n_out('t3', 'amount')}),
 (10, 'Outliers', 'o_orderkey', 'winsorize', 'done', {fence_text('t4', 'o_orderkey')}, {n_out('t4', 'o_orderkey')})
) v(step_no, step, "column", action, status, value, impact)""", "dirty")


def auto_clean() -> str:
    keep = [c for c in DIRTY_COLS if c != "mostly_null"]
    t1 = _select_with({"cust_txt": _num("cust_txt"), "date_txt": parse_ts("date_txt")})
    t2 = ", ".join(
        "COALESCE(amount, (SELECT quantile_cont(amount, 0.5) FROM t1)) AS amount" if c == "amount" else
        f"COALESCE(priority, {_mode_text('t1', 'priority')}) AS priority" if c == "priority" else qi(c) for c in keep)
    t4 = ", ".join("CASE WHEN amount < f.lo THEN f.lo WHEN amount > f.hi THEN f.hi ELSE amount END AS amount"
                   if c == "amount" else qi(c) for c in keep)
    return wrap(f"""WITH t1 AS (SELECT {t1} FROM dirty),
t2 AS (SELECT {t2} FROM t1),
t3 AS (SELECT DISTINCT * FROM t2),
f AS {_fences('t3', 'amount')}
SELECT {t4} FROM t3, f""", "dirty")
