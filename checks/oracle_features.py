"""Oracle SQL for feature engineering."""

from __future__ import annotations

from checks.oracle import SCHEMAS, num_cols, parse_ts, qi, union, wrap


def _cols(table, replace=None, drop=()):
    replace = replace or {}
    return ", ".join(f"{replace.get(c, qi(c))} AS {qi(c)}" for c, _ in SCHEMAS[table] if c not in drop)


def remove_id_features() -> str:
    # order_id holds "id"; no other string/integer column is unique on every row (checked below)
    uniq = " AND ".join(f"(SELECT count(DISTINCT {qi(c)}) FROM fe_input) < (SELECT count(*) FROM fe_input)"
                        for c, t in SCHEMAS["fe_input"] if t in ("string", "bigint", "int") and c != "order_id")
    return wrap(f"SELECT {_cols('fe_input', drop=('order_id',))} FROM fe_input WHERE {uniq}", "fe_input")


def _parts(expr: str, prefix: str, cyclic: bool = True) -> list[str]:
    d = f"CAST({expr} AS DATE)"
    out = [f"CAST(year({d}) AS INT) AS {prefix}_year", f"CAST(month({d}) AS INT) AS {prefix}_month",
           f"CAST(day({d}) AS INT) AS {prefix}_day", f"CAST(isodow({d}) - 1 AS INT) AS {prefix}_weekday",
           f"CAST(quarter({d}) AS INT) AS {prefix}_quarter", f"CAST(week({d}) AS INT) AS {prefix}_week_of_year",
           f"CAST(COALESCE(isodow({d}) - 1 >= 5, false) AS INT) AS {prefix}_is_weekend",
           f"CAST(COALESCE(day({d}) = 1, false) AS INT) AS {prefix}_is_month_start",
           f"CAST(COALESCE({d} = last_day({d}), false) AS INT) AS {prefix}_is_month_end"]
    if cyclic:
        out += _cyclic(d, prefix)
    return out


def _cyclic(d: str, prefix: str) -> list[str]:
    return [f"round(sin(2 * pi() * month({d}) / 12), 6) AS {prefix}_month_sin",
            f"round(cos(2 * pi() * month({d}) / 12), 6) AS {prefix}_month_cos",
            f"round(sin(2 * pi() * (isodow({d}) - 1) / 7), 6) AS {prefix}_weekday_sin",
            f"round(cos(2 * pi() * (isodow({d}) - 1) / 7), 6) AS {prefix}_weekday_cos"]


def datetime_features() -> str:
    return wrap(f"SELECT {_cols('fe_input', drop=('order_date',))}, {', '.join(_parts(parse_ts('order_date'), 'order_date'))} "
                f"FROM fe_input", "fe_input")


def cyclic_features() -> str:
    cols = ", ".join(qi(c) for c, _ in SCHEMAS["orders"])
    return f"SELECT {cols}, {', '.join(_cyclic('o_orderdate', 'o_orderdate'))} FROM orders"


def bool_to_int() -> str:
    return wrap(f"SELECT {_cols('fe_input', {'is_final': 'CAST(is_final AS INT)'})} FROM fe_input", "fe_input")


def rare_categories() -> str:
    rep = {}
    for c, t in SCHEMAS["fe_input"]:
        if t == "string":
            freq = (f"(SELECT {qi(c)} FROM fe_input WHERE {qi(c)} IS NOT NULL GROUP BY {qi(c)} "
                    f"HAVING count(*) / (SELECT count({qi(c)}) FROM fe_input) >= 0.01)")
            rep[c] = f"CASE WHEN {qi(c)} IS NULL OR {qi(c)} IN {freq} THEN {qi(c)} ELSE 'Other' END"
    return wrap(f"SELECT {_cols('fe_input', rep)} FROM fe_input", "fe_input")


def constant_columns(table: str) -> str:
    parts = [f"SELECT '{c}' AS \"column\" FROM {table} HAVING count(DISTINCT {qi(c)}) "
             f"+ CASE WHEN count(*) > count({qi(c)}) THEN 1 ELSE 0 END <= 1" for c, _ in SCHEMAS[table]]
    return wrap(union(parts), table)


def low_variance(table: str) -> str:
    parts = [f"SELECT '{c}' AS \"column\", var_pop(CAST({qi(c)} AS DOUBLE)) * count({qi(c)}) / count(*) > 0.01 AS kept "
             f"FROM {table}" for c in num_cols(table)]
    return wrap(union(parts), table)


def correlated(table: str) -> str:
    cols = num_cols(table)
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
            f = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
            r = (f"CASE WHEN stddev_pop({x}) {f} * stddev_pop({y}) {f} <> 0 THEN covar_pop({x}, {y}) {f} / "
                 f"(stddev_pop({x}) {f} * stddev_pop({y}) {f}) END")
            parts.append(f"SELECT '{b}' AS \"column\" FROM {table} HAVING abs({r}) > 0.95")
    return wrap(f"SELECT DISTINCT \"column\" FROM ({union(parts)})", table)


def interaction_features() -> str:
    extra = ("total_price * acct_balance AS total_price_x_acct_balance, "
             "CASE WHEN acct_balance <> 0 THEN total_price / acct_balance END AS total_price_div_acct_balance, "
             "acct_balance * nation AS acct_balance_x_nation, "
             "CASE WHEN nation <> 0 THEN acct_balance / CAST(nation AS DOUBLE) END AS acct_balance_div_nation")
    return wrap(f"SELECT {_cols('fe_input')}, {extra} FROM fe_input", "fe_input")


def cap_outliers() -> str:
    rep, fences = {}, []
    for i, c in enumerate(num_cols("dirty")):
        x = f"CAST({qi(c)} AS DOUBLE)"
        fences.append(f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
                      f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM dirty)) f{i}")
        rep[c] = f"CASE WHEN {x} < f{i}.lo THEN f{i}.lo WHEN {x} > f{i}.hi THEN f{i}.hi ELSE {x} END"
    return wrap(f"SELECT {_cols('dirty', rep)} FROM dirty, {', '.join(fences)}", "dirty")


def fill_zero() -> str:
    rep = {c: (f"COALESCE({qi(c)}, 0)" if t in ("bigint", "int", "double") else
               f"COALESCE({qi(c)}, '0')" if t == "string" else qi(c)) for c, t in SCHEMAS["dirty"]}
    return wrap(f"SELECT {_cols('dirty', rep)} FROM dirty", "dirty")


def mutual_information(table: str, target: str, bins: int = 10) -> str:
    parts = []
    for c in num_cols(table):
        x = f"COALESCE(CAST({qi(c)} AS DOUBLE), 0.0)"
        parts.append(f"""
SELECT '{c}' AS "column", sum(pxy * ln(pxy / (px * py))) AS mi FROM (
  SELECT nxy / n AS pxy, sum(nxy) OVER (PARTITION BY bin) / n AS px, sum(nxy) OVER (PARTITION BY y) / n AS py
  FROM (SELECT bin, y, count(*) AS nxy, sum(count(*)) OVER () AS n FROM (
          SELECT y, CAST(floor((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 - 1)
                               * {bins} / count(*) OVER ()) AS INT) AS bin
          FROM (SELECT {x} AS v, CAST({qi(target)} AS VARCHAR) AS y FROM {table} WHERE {qi(target)} IS NOT NULL))
        GROUP BY bin, y))""")
    return wrap(f"SELECT \"column\", round(mi, 6) AS mi FROM ({union(parts)})", table)


def select_k_best(k: int = 3) -> str:
    """fe_input, target status: top-k numeric columns by binned MI, after the sorted non-numeric ones."""
    mi = mutual_information("fe_input", "status")
    numeric = [c for c, t in SCHEMAS["fe_input"] if t in ("bigint", "int", "double")]
    others = sorted(c for c, t in SCHEMAS["fe_input"] if c not in numeric and c != "status")
    pos = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(numeric))
    return f"""
WITH m AS ({mi}),
top AS (SELECT "column", CASE "column" {pos} END AS p FROM m
        QUALIFY row_number() OVER (ORDER BY mi DESC, CASE "column" {pos} END) <= {k}),
cols AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(others))}) v("column", o)
         UNION ALL SELECT "column", {len(others)} + row_number() OVER (ORDER BY p) - 1 FROM top
         UNION ALL SELECT 'status', {len(others) + k})
SELECT CAST(o AS BIGINT) AS position, "column" FROM cols"""
