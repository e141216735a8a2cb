"""DuckDB text of the fixture views, used only by the oracle statements.

``with_views(sql)`` prefixes a statement with the CTEs of every view it
names, so the oracle runs against the base tables the driver registers.
"""

from __future__ import annotations

import re

from quire.sources.views import CAMPAIGNS, RECIPES, TOPPINGS


def _values(rows: list[tuple], names: str, kinds: tuple[str, ...]) -> str:
    """A literal table of the fixed values of ``quire.sources.views``."""
    text = ", ".join("(" + ", ".join(f"{kind} '{v}'" if kind else f"'{v}'" if isinstance(v, str) else str(v)
                                     for v, kind in zip(row, kinds)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({names})"


VIEW_SQL = {
    "v_sale": """
SELECT o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS order_date, l.l_orderkey AS order_id, l.l_linenumber AS line_no,
       l.l_partkey AS product_id, p.p_type AS product_name, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_member": """
SELECT o_custkey AS customer_id, CAST(min(o_orderdate) AS DATE) AS join_date
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey""",
    "v_sub": """
SELECT o_custkey AS customer_id, o_orderkey AS event_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS plan_id,
       CAST(o_orderdate AS DATE) AS start_date,
       CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 9.90 WHEN '3' THEN 19.90 WHEN '4' THEN 199 END AS DECIMAL(5,2)) AS price
FROM orders""",
    "v_node": """
SELECT o.o_custkey AS customer_id, n.n_regionkey AS region_id, o.o_orderpriority AS node_id, CAST(o.o_orderdate AS DATE) AS start_date,
       coalesce(lead(CAST(o.o_orderdate AS DATE)) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey), DATE '9999-12-31') AS end_date
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "v_txn": """
SELECT o_orderkey AS txn_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS txn_date,
       CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'purchase' ELSE 'withdrawal' END AS txn_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS txn_amount
FROM orders""",
    "v_weekly": """
SELECT CAST(date_trunc('week', l.l_shipdate) AS DATE) AS week_date, r.r_name AS region, l.l_linestatus AS platform,
       CASE WHEN l.l_linenumber % 5 = 0 THEN 'null' ELSE concat(CASE WHEN c.c_mktsegment < 'C' THEN 'C' ELSE 'F' END, CAST(l.l_linenumber % 5 AS VARCHAR(2))) END AS segment,
       l.l_returnflag AS customer_type, count(*) AS transactions, CAST(round(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))), 0) AS BIGINT) AS sales
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY 1, 2, 3, 4, 5""",
    "v_event": """
SELECT event_id, user_id, concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS visit_id, ts AS event_time,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS event_type,
       CAST(event_id % 13 AS INT) AS page_id
FROM events""",
    "v_page": """
SELECT DISTINCT CAST(event_id % 13 AS INT) AS page_id, concat('page_', CAST(event_id % 13 AS VARCHAR(4))) AS page_name,
       CASE WHEN event_id % 13 BETWEEN 3 AND 11 THEN concat('cat_', CAST((event_id % 13) % 3 AS VARCHAR(4))) END AS product_category,
       CASE WHEN event_id % 13 BETWEEN 3 AND 11 THEN CAST(event_id % 13 - 2 AS INT) END AS product_id
FROM events""",
    "v_campaign": _values(CAMPAIGNS, "campaign_name, start_date, end_date", ("", "TIMESTAMP", "TIMESTAMP")),
    "v_recipe": _values(RECIPES, "item_name, toppings", ("", "")),
    "v_topping": _values(TOPPINGS, "topping_id, topping_name", ("", "")),
    "v_item": """
SELECT l.l_orderkey AS order_id,
       CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice, l.l_tax, l.l_discount) AS INT) AS item_no,
       l.l_partkey AS part_id, p.p_type AS item_name,
       CASE l.l_returnflag WHEN 'R' THEN concat(CAST(l.l_linenumber AS VARCHAR(2)), ', ', CAST(l.l_linenumber + 2 AS VARCHAR(2)))
                           WHEN 'A' THEN 'null' ELSE CASE WHEN l.l_linestatus = 'O' THEN '' ELSE '4' END END AS exclusions,
       CASE WHEN l.l_suppkey % 4 = 0 THEN CAST(1 + l.l_suppkey % 12 AS VARCHAR(2)) WHEN l.l_suppkey % 4 = 1 THEN 'null'
            WHEN l.l_suppkey % 4 = 2 THEN '' END AS extras
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_dirty": """
SELECT o_orderkey AS order_id, o_custkey % 10 AS runner_id, o_custkey AS customer_id, o_orderdate AS order_time,
       CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), ' 00:', CAST(10 + o_orderkey % 50 AS VARCHAR(2)), ':34') END AS pickup_time,
       CASE WHEN o_orderkey % 11 = 0 THEN 'null' WHEN o_orderkey % 3 = 0 THEN concat(CAST(5 + o_orderkey % 20 AS VARCHAR(4)), '.4 km')
            WHEN o_orderkey % 3 = 1 THEN concat(CAST(5 + o_orderkey % 20 AS VARCHAR(4)), 'km') ELSE CAST(5 + o_orderkey % 20 AS VARCHAR(4)) END AS distance,
       CASE WHEN o_orderkey % 11 = 0 THEN 'null' WHEN o_orderkey % 4 = 0 THEN concat(CAST(10 + o_orderkey % 110 AS VARCHAR(4)), ' minutes')
            WHEN o_orderkey % 4 = 1 THEN concat(CAST(10 + o_orderkey % 110 AS VARCHAR(4)), 'mins') ELSE CAST(10 + o_orderkey % 110 AS VARCHAR(4)) END AS duration,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Customer Cancellation' WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'null' END AS cancellation
FROM orders""",
    "v_rating": """
SELECT CASE WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS order_id, o_custkey % 10 AS runner_id, o_custkey AS customer_id,
       CASE WHEN o_orderkey % 101 = 0 THEN 78 ELSE CAST(1 + o_orderkey % 5 AS INT) END AS rating
FROM orders""",
}

_NAME = re.compile(r"\bv_[a-z]+\b")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for the fixture views it references."""
    used = [v for v in VIEW_SQL if v in set(_NAME.findall(sql))]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in used)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
