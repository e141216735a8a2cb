"""Catalogue entries for the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.calendar import minutes_between
from quire.functions.text import null_if_token
from quire.operators import aggs as A
from quire.plans.cleaning import NUM_RE
from quire.plans.common import (DELIVERED_SQL, ITEM_PRICE_SQL, delivered_items, delivered_orders, deliveries,
                                item_price, pct_sql, weekly)
from quire.plans.registry import register
from quire.sources.sinks import materialize
from quire.sources.views import OPEN_END, Views

# exact mean in 1e-4 units, rounded half away from zero (cents summed as integers)
EXACT_MEAN_SQL = ("CAST(CAST(sign(sum(CAST(txn_amount * 100 AS HUGEINT))) * ((2 * 100 * abs(sum(CAST(txn_amount * 100 AS HUGEINT)))"
                  " + count(txn_amount)) // (2 * count(txn_amount))) AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(38,4))")
TOTALS_SQL = f"""count(*) AS n_rows, CAST(sum(txn_amount) AS DECIMAL(38,2)) AS total_amount,
       {EXACT_MEAN_SQL} AS avg_amount, min(txn_amount) AS min_amount, max(txn_amount) AS max_amount"""


@register("totals_by", "W30", f"SELECT txn_type, {TOTALS_SQL} FROM v_txn GROUP BY txn_type")
def q_totals_by(v: Views):
    return A.totals_by(v.v_txn, ["txn_type"], "txn_amount", money_scale=2)


@register("total_global", "W30", f"SELECT {TOTALS_SQL} FROM v_txn")
def q_total_global(v: Views):
    return A.totals_by(v.v_txn, [], "txn_amount", money_scale=2)


@register("percentiles_by", "W31", """
SELECT region_id, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.8), 4) AS p80,
       round(quantile_cont(d, 0.95), 4) AS p95
FROM (SELECT region_id, date_diff('day', start_date, end_date) AS d FROM v_node WHERE end_date <> DATE '9999-12-31') t
GROUP BY region_id""")
def q_percentiles_by(v: Views):
    closed = (v.v_node.where(F.col("end_date") != F.lit(OPEN_END).cast("date"))
              .withColumn("duration", F.datediff("end_date", "start_date")))
    return A.percentiles_by(closed, ["region_id"], "duration")


@register("percentiles_by_rank", "W31", """
SELECT l_returnflag AS return_flag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median,
       round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.8), 4) AS p80, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS p95
FROM lineitem GROUP BY l_returnflag""")
def q_percentiles_by_rank(v: Views):
    lines = v.t.lineitem.select(F.col("l_returnflag").alias("return_flag"), F.col("l_extendedprice").cast("double").alias("price"))
    return A.percentiles_by_rank(lines, ["return_flag"], "price")


@register("distinct_rollup", "W32", """
SELECT CASE WHEN d IS NOT NULL THEN 'day' WHEN m IS NOT NULL THEN 'month' ELSE 'all' END AS level,
       CAST(coalesce(d, m) AS DATE) AS start, count(DISTINCT user_id) AS n_distinct
FROM (SELECT user_id, CAST(event_time AS DATE) AS d, CAST(date_trunc('month', event_time) AS DATE) AS m FROM v_event) t
GROUP BY GROUPING SETS ((d), (m), ())""")
def q_distinct_rollup(v: Views):
    stored = materialize(A.daily_bitmaps(v.v_event, F.col("event_time").cast("date"), "user_id"), "daily_users", partition_by=["day"])
    return A.distinct_rollup(stored)


@register("distinct_by", "W32", "SELECT region_id, count(DISTINCT node_id) AS n_nodes FROM v_node GROUP BY region_id")
def q_distinct_by(v: Views):
    return A.distinct_by(v.v_node_lines, ["region_id"], "node_id", "n_nodes")


@register("distinct_pairs", "W32", "SELECT DISTINCT region_id, node_id FROM v_node")
def q_distinct_pairs(v: Views):
    return A.distinct_pairs(v.v_node_lines, ["region_id", "node_id"])


@register("distinct_groups", "W32", """
SELECT region_id, node_id, count(DISTINCT customer_id) AS n_customers FROM v_node GROUP BY region_id, node_id""")
def q_distinct_groups(v: Views):
    return A.distinct_by(v.v_node_lines, ["region_id", "node_id"], "customer_id", "n_customers")


@register("conditional_counts", "W33", """
SELECT p.product_category, count(*) FILTER (WHERE e.event_type = 1) AS page_views,
       count(*) FILTER (WHERE e.event_type = 2) AS cart_adds
FROM v_event e JOIN v_page p ON p.page_id = e.page_id
WHERE p.product_category IS NOT NULL GROUP BY p.product_category""")
def q_conditional_counts(v: Views):
    pages = v.v_page.where(F.col("product_category").isNotNull())
    return A.conditional_counts(v.v_event.join(pages, "page_id"), ["product_category"],
                                {"page_views": F.col("event_type") == 1, "cart_adds": F.col("event_type") == 2})


@register("qualifying_groups", "W34", """
SELECT month, count(*) AS customer_count FROM (
  SELECT customer_id, CAST(month(txn_date) AS INTEGER) AS month,
         count(*) FILTER (WHERE txn_type = 'deposit') AS d, count(*) FILTER (WHERE txn_type = 'purchase') AS p,
         count(*) FILTER (WHERE txn_type = 'withdrawal') AS w
  FROM v_txn GROUP BY 1, 2) t
WHERE d >= 2 AND (p >= 1 OR w >= 1) GROUP BY month""")
def q_qualifying_groups(v: Views):
    rule = (F.col("deposit_count") >= 2) & ((F.col("purchase_count") >= 1) | (F.col("withdrawal_count") >= 1))
    return A.qualifying_groups(v.v_txn, "customer_id", F.month("txn_date"), "txn_type", rule)


@register("share_by_platform_month", "W35", f"""
WITH m AS (SELECT CAST(year(week_date) AS INTEGER) AS calendar_year, CAST(month(week_date) AS INTEGER) AS month_number,
                  platform, sum(sales) AS s FROM v_weekly GROUP BY 1, 2, 3),
     t AS (SELECT *, sum(s) OVER (PARTITION BY calendar_year, month_number) AS tot FROM m)
SELECT calendar_year, month_number, platform, CAST(s AS BIGINT) AS platform_monthly_sales,
       {pct_sql('s', 'tot')} AS platform_perc
FROM t""")
def q_share_by_platform_month(v: Views):
    return A.share_of_parent(weekly(v), ["calendar_year", "month_number"], ["platform"], "sales",
                             "platform_monthly_sales", None, "platform_perc")


@register("share_by_segment_year", "W35", f"""
WITH m AS (SELECT CAST(year(week_date) AS INTEGER) AS calendar_year,
                  CASE left(segment, 1) WHEN 'C' THEN 'Couples' WHEN 'F' THEN 'Families' ELSE 'Unknown' END AS demographic,
                  sum(sales) AS s FROM v_weekly GROUP BY 1, 2),
     t AS (SELECT *, sum(s) OVER (PARTITION BY calendar_year) AS tot FROM m)
SELECT calendar_year, demographic, CAST(s AS BIGINT) AS demographic_sales, CAST(tot AS BIGINT) AS yearly_sales,
       {pct_sql('s', 'tot')} AS demo_sales_perc
FROM t""")
def q_share_by_segment_year(v: Views):
    return A.share_of_parent(weekly(v), ["calendar_year"], ["demographic"], "sales",
                             "demographic_sales", "yearly_sales", "demo_sales_perc")


@register("share_of_population", "W36", f"""
SELECT total_customer, churn, {pct_sql('churn', 'total_customer', 1)} AS churn_perc FROM (
  SELECT count(DISTINCT customer_id) AS total_customer, count(*) FILTER (WHERE plan_id = 4) AS churn FROM v_sub) t""")
def q_share_of_population(v: Views):
    return A.share_of_population(v.v_sub, "customer_id", F.col("plan_id") == 4, scale=1)


@register("two_level_avg", "W37", """
SELECT round(avg(CAST(n AS DOUBLE)), 4) AS avg_visits_per_user
FROM (SELECT user_id, count(DISTINCT visit_id) AS n FROM v_event GROUP BY user_id) t""")
def q_two_level_avg(v: Views):
    return A.two_level_avg(v.v_event, "user_id", "visit_id", "avg_visits_per_user")


@register("revenue_by_type", "W38", f"""
SELECT item_name, count(*) AS n_items, CAST(count(*) * {ITEM_PRICE_SQL} AS BIGINT) AS revenue
FROM v_item WHERE order_id IN (SELECT order_id FROM v_dirty WHERE {DELIVERED_SQL})
GROUP BY item_name""")
def q_revenue_by_type(v: Views):
    return A.group_revenue(delivered_items(v), "item_name", item_price())


@register("profit_after_cost", "W38", f"""
SELECT CAST(round(sum(p), 2) AS DECIMAL(38,2)) AS profit FROM (
  SELECT i.order_id, sum({ITEM_PRICE_SQL}) - avg(d.dist * 0.30) AS p
  FROM v_item i JOIN (SELECT order_id, TRY_CAST(NULLIF(regexp_extract(distance, {NUM_RE}, 1), '') AS DECIMAL(10,2)) AS dist
                      FROM v_dirty WHERE {DELIVERED_SQL}) d ON d.order_id = i.order_id
  GROUP BY i.order_id) t""")
def q_profit_after_cost(v: Views):
    items = v.v_item_lines.join(delivered_orders(v).select("order_id", "distance"), "order_id")
    return A.profit_after_cost(items, "order_id", item_price(), "distance")


@register("weighted_vs_plain_avg", "W39", """
SELECT CAST(year(week_date) AS INTEGER) AS calendar_year, platform,
       CAST(sum(sales) // sum(transactions) AS BIGINT) AS correct_avg,
       CAST(CAST((2 * sum(a_cents) + count(*)) // (2 * count(*)) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(12,2)) AS incorrect_avg
FROM (SELECT *, (200 * CAST(sales AS HUGEINT) + transactions) // (2 * transactions) AS a_cents FROM v_weekly) t
GROUP BY 1, 2""")
def q_weighted_vs_plain_avg(v: Views):
    return A.weighted_vs_plain_avg(weekly(v), ["calendar_year", "platform"], "sales", "transactions",
                                   "avg_transaction")


@register("success_rate", "W40", f"""
SELECT runner_id, {pct_sql('count(order_id) - count(c)', 'count(order_id)')} AS success_pct
FROM (SELECT runner_id, order_id, CASE WHEN cancellation IN ('null', '') THEN NULL ELSE cancellation END AS c FROM v_dirty) t
GROUP BY runner_id""")
def q_success_rate(v: Views):
    return A.success_rate(deliveries(v), "runner_id", "order_id", "cancellation")


@register("range_of_elapsed", "W41", """
SELECT round(max(m) - min(m), 4) AS difference FROM (
  SELECT date_diff('second', order_time, TRY_CAST(CASE WHEN pickup_time IN ('null', '') THEN NULL ELSE pickup_time END AS TIMESTAMP)) / 60.0 AS m
  FROM v_dirty) t""")
def q_range_of_elapsed(v: Views):
    return A.range_of(deliveries(v), minutes_between("order_time", "pickup_time"))


@register("share_of_visits_buying", "W36", f"""
SELECT count(*) AS n_visits, count(*) FILTER (WHERE b) AS n_buying, {pct_sql('count(*) FILTER (WHERE b)', 'count(*)')} AS buying_perc
FROM (SELECT visit_id, bool_or(event_type = 3) AS b FROM v_event GROUP BY visit_id) t""")
def q_share_of_visits_buying(v: Views):
    return A.share_of_keys(v.v_event, "visit_id", F.col("event_type") == 3, names=("n_visits", "n_buying", "buying_perc"))


@register("visits_per_month", "W32", """
SELECT CAST(month(event_time) AS INTEGER) AS month_number, count(DISTINCT visit_id) AS n_visits FROM v_event GROUP BY 1""")
def q_visits_per_month(v: Views):
    return A.distinct_by(v.v_event.withColumn("month_number", F.month("event_time")), ["month_number"], "visit_id", "n_visits")


@register("item_change_counts", "W33", """
SELECT item_name, count(*) FILTER (WHERE e OR x) AS n_changed, count(*) FILTER (WHERE NOT (e OR x)) AS n_unchanged,
       count(*) FILTER (WHERE e AND x) AS n_both
FROM (SELECT item_name, coalesce(exclusions NOT IN ('null', ''), false) AS e,
             coalesce(extras NOT IN ('null', ''), false) AS x FROM v_item) t GROUP BY item_name""")
def q_item_change_counts(v: Views):
    e, x = (null_if_token(c).isNotNull() for c in ("exclusions", "extras"))
    return A.conditional_counts(v.v_item_lines, ["item_name"], {"n_changed": e | x, "n_unchanged": ~(e | x), "n_both": e & x})
