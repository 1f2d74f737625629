"""SQL text of the derived views, runnable by DuckDB (mirrors ``quarry.plans.fixtures``)."""

VIEWS = {
    "dirty": """
WITH base AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20
              ELSE o_totalprice END                                   AS amount,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
              ELSE CAST(o_custkey AS VARCHAR) END                     AS cust_txt,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR)                   AS date_txt,
         (o_orderstatus = 'F')                                        AS is_final,
         CAST(1 AS INT)                                               AS const_one,
         CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_orderstatus END AS mostly_null
  FROM orders)
SELECT * FROM base
UNION ALL
SELECT * FROM base WHERE o_orderkey % 20 = 0""",
    "scored_binary": """
SELECT o_orderkey AS id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       CAST((o_orderkey * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
       CASE WHEN (o_orderkey * 37) % 1000 > 500 THEN 1 ELSE 0 END AS prediction
FROM orders""",
    "scored_multi": """
SELECT o_orderkey AS id, o_orderpriority AS label,
       CASE WHEN o_orderkey % 7 = 0 THEN 'NONE'
            WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END AS prediction
FROM orders""",
    "scored_regression": """
SELECT o_orderkey AS id, o_totalprice AS label,
       o_totalprice * (CAST(90 AS DOUBLE) + CAST(o_orderkey % 21 AS DOUBLE)) / CAST(100 AS DOUBLE) AS prediction
FROM orders""",
    "scored_proba": """
SELECT o_orderkey AS id, o_orderpriority AS label,
       exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) / (exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END))) AS p0,
       exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) / (exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END))) AS p1,
       exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) / (exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END))) AS p2,
       exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) / (exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END))) AS p3,
       exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END)) / (exp((CAST((o_orderkey * 3) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 4) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 5) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 6) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.5 ELSE 0.0 END)) + exp((CAST((o_orderkey * 7) % 97 AS DOUBLE) / 97.0 + CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0.0 END))) AS p4
FROM orders""",
    "fe_input": """
SELECT o.o_orderkey AS order_id, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS order_date,
       o.o_totalprice AS total_price, o.o_totalprice * 2 AS price_double, o.o_orderstatus AS status,
       o.o_orderpriority AS priority, c.c_acctbal AS acct_balance, c.c_mktsegment AS segment,
       c.c_name AS customer_name, (o.o_orderstatus = 'F') AS is_final, c.c_nationkey AS nation,
       CAST(o.o_orderkey % 3 AS DOUBLE) / CAST(100 AS DOUBLE) AS discount_rate, 'x' AS const_txt
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views."""
    if not names:
        return sql
    defs = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {defs},\n{body[5:]}"
    return f"WITH {defs}\n{body}"
