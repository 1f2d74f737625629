"""Oracle SQL for dataset validation and preparation."""

from __future__ import annotations

from checks.oracle import SCHEMAS, num_cols, parse_ts, qi, union, wrap


def bucket(key: str, seed: int = 42, salt: str = "") -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}{salt}'), 1, 8) AS BIGINT) % 10000)"


def validate_dataset(table: str) -> str:
    n = len(SCHEMAS[table])
    return wrap(f"""
SELECT * FROM (VALUES
 ('non_empty', (SELECT count(*) > 0 FROM {table}), 'error'),
 ('min_rows', (SELECT count(*) >= 20 FROM {table}), 'error'),
 ('min_columns', {n} >= 2, 'error'),
 ('unique_column_names', true, 'error'),
 ('no_duplicate_rows', (SELECT count(*) FROM {table}) = (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})), 'warning')
) v("check", passed, severity)""", table)


def detect_target_orders() -> str:
    return ("SELECT CASE WHEN count(DISTINCT o_orderpriority) / count(*) < 0.9 THEN 'o_orderpriority' END AS target "
            "FROM orders")


def validate_target(table: str, target: str) -> str:
    t = qi(target)
    return wrap(f"""
WITH s AS (SELECT count(*) AS n_rows, count({t}) AS n_present, count(DISTINCT {t}) AS n_unique FROM {table})
SELECT 'not_all_null' AS "check", n_present > 0 AS passed, 'error' AS severity FROM s
UNION ALL SELECT 'more_than_one_value', n_unique > 1, 'error' FROM s
UNION ALL SELECT 'missing_at_most_half', n_rows - n_present <= n_rows * 0.5, 'warning' FROM s
UNION ALL SELECT 'at_least_two_classes', n_unique >= 2, 'warning' FROM s""", table)


def detect_problem_type(table: str, target: str, text: bool = False) -> str:
    t = qi(target)
    rule = ("'classification'" if text else
            "CASE WHEN n_unique / n_rows <= 0.05 OR n_unique <= 20 THEN 'classification' ELSE 'regression' END")
    return wrap(f"""SELECT '{target}' AS target, {rule} AS problem_type, n_unique, n_rows
FROM (SELECT count(*) AS n_rows, count(DISTINCT {t}) AS n_unique FROM {table})""", table)


def split_features(table: str, target: str) -> str:
    cols = ", ".join(qi(c) for c, _ in SCHEMAS[table] if c != target)
    return wrap(f"SELECT {cols} FROM {table}", table)


def feature_types(table: str) -> str:
    rows = []
    for i, (c, t) in enumerate(SCHEMAS[table]):
        kind = ("numerical" if t in ("bigint", "int", "double") else "categorical" if t == "string" else
                "boolean" if t == "boolean" else "datetime")
        rows.append(f"('{c}', {i}, '{kind}')")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(\"column\", position, feature_type)"


def convert_datetime_features() -> str:
    """dirty: a string column converts when every non-null value parses and non-null share > 0.8."""
    def conv(c):
        return (f"(SELECT count(*) FILTER (WHERE {qi(c)} IS NOT NULL AND {parse_ts(qi(c))} IS NULL) = 0 "
                f"AND count({qi(c)}) > count(*) * 0.8 FROM dirty)")
    sel = []
    for c, t in SCHEMAS["dirty"]:
        if t == "string":
            sel.append(f"CASE WHEN {conv(c)} THEN CAST({parse_ts(qi(c))} AS VARCHAR) ELSE {qi(c)} END AS {qi(c)}")
        else:
            sel.append(qi(c))
    return wrap(f"SELECT {', '.join(sel)} FROM dirty", "dirty")


def detect_id_columns(table: str) -> str:
    hints = ["id", "customer_id", "order_id", "emp_id", "employee_id", "uuid", "index"]
    parts = [f"SELECT '{c}' AS \"column\" FROM {table} HAVING lower('{c}') IN ({', '.join(repr(h) for h in hints)}) "
             f"OR count(DISTINCT {qi(c)}) / count(*) >= 0.98" for c, _ in SCHEMAS[table]]
    return wrap(union(parts), table)


def class_imbalance(table: str, target: str) -> str:
    t = qi(target)
    return wrap(f"""SELECT round(max(cnt) / sum(cnt), 6) AS max_share, max(cnt) / sum(cnt) > 0.95 AS is_imbalanced
FROM (SELECT count(*) AS cnt FROM {table} WHERE {t} IS NOT NULL GROUP BY {t})""", table)


def impute_scale(table: str) -> str:
    cols = num_cols(table)
    fits = []
    for c in cols:
        x = f"CAST({qi(c)} AS DOUBLE)"
        fits.append(f"""(SELECT md, avg(COALESCE({x}, md)) AS mn,
       CASE WHEN stddev_pop(COALESCE({x}, md)) > 0 THEN stddev_pop(COALESCE({x}, md)) ELSE 1.0 END AS sc
 FROM {table}, (SELECT quantile_cont({x}, 0.5) AS md FROM {table}) GROUP BY md) f_{c}""")
    sel = ", ".join(f"round((COALESCE(CAST({qi(c)} AS DOUBLE), f_{c}.md) - f_{c}.mn) / f_{c}.sc, 6) AS {qi('__num_' + str(i))}"
                    for i, c in enumerate(cols))
    keys = ", ".join(f"t.{qi(c)}" for c, _ in SCHEMAS[table])
    return wrap(f"SELECT {keys}, {sel} FROM {table} t, {', '.join(fits)}", table)


def impute_onehot(table: str, col: str, key: str) -> str:
    c = qi(col)
    return wrap(f"""
WITH mode AS (SELECT {c} AS m FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),
filled AS (SELECT {qi(key)} AS k, COALESCE({c}, (SELECT m FROM mode)) AS v FROM {table}),
cats AS (SELECT list(v ORDER BY v) AS ls FROM (SELECT DISTINCT v FROM filled))
SELECT k AS {qi(key)}, list_transform(ls, lambda x: CASE WHEN x = v THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS onehot
FROM filled, cats""", table)


def train_test_split(table: str, key: str) -> str:
    return wrap(f"SELECT {qi(key)}, {bucket(qi(key))} < 2000 AS is_test FROM {table}", table)


def stratified_split(table: str, key: str, label: str) -> str:
    k, y = qi(key), qi(label)
    return wrap(f"""
SELECT {k}, (row_number() OVER (PARTITION BY {y} ORDER BY {bucket(k)}, {k}) - 1)
             < round(count(*) OVER (PARTITION BY {y}) * 0.2) AS is_test
FROM {table}""", table)


def assemble_features() -> str:
    """orders: scaled o_totalprice (median fill, population std), then one-hot status and priority (sorted)."""
    def parts(col, tag):
        return (f"m_{tag} AS (SELECT {col} AS m FROM orders WHERE {col} IS NOT NULL GROUP BY {col} "
                f"ORDER BY count(*) DESC, {col} LIMIT 1),\n"
                f"l_{tag} AS (SELECT list(v ORDER BY v) AS l FROM (SELECT DISTINCT {col} AS v FROM orders "
                f"WHERE {col} IS NOT NULL))")

    def onehot(col, tag):
        return (f"list_transform(l_{tag}.l, lambda x: CASE WHEN x = COALESCE({col}, m_{tag}.m) "
                f"THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
    return f"""
WITH s AS (SELECT md, avg(COALESCE(o_totalprice, md)) AS mn,
                  CASE WHEN stddev_pop(COALESCE(o_totalprice, md)) > 0 THEN stddev_pop(COALESCE(o_totalprice, md))
                       ELSE 1.0 END AS sc
           FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS md FROM orders) GROUP BY md),
{parts('o_orderstatus', 'st')},
{parts('o_orderpriority', 'pr')}
SELECT o_orderkey, list_concat([round((COALESCE(o_totalprice, s.md) - s.mn) / s.sc, 9)],
                               {onehot('o_orderstatus', 'st')}, {onehot('o_orderpriority', 'pr')}) AS features
FROM orders, s, m_st, l_st, m_pr, l_pr"""


def validate_scoring_input() -> str:
    return """
SELECT * FROM (VALUES
 ('has_rows', (SELECT count(*) > 0 FROM documents d JOIN labels l USING (doc_id)), ''),
 ('required_columns', false, 'toxic')) v("check", passed, detail)"""
