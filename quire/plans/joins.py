"""Catalogue entries for the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.calendar import sunday_week
from quire.operators import joins as J
from quire.operators.windows import missing_runs
from quire.plans.registry import register
from quire.sources.views import Views

SALE_ORDER = ["order_date", "order_id", "line_no", "product_id", "price"]


@register("enrich_total", "W20", """
SELECT customer_id, CAST(sum(price) AS DECIMAL(38,2)) AS total_amount, count(*) AS n_items
FROM v_sale GROUP BY customer_id""")
def q_enrich_total(v: Views):
    return J.enrich_total(v.v_sale, ["customer_id"], "price")


@register("enrich_total_dims", "W20", """
SELECT c.c_mktsegment AS segment, p.p_brand AS brand, CAST(sum(s.price) AS DECIMAL(38,2)) AS total_amount, count(*) AS n_items
FROM v_sale s JOIN customer c ON c.c_custkey = s.customer_id JOIN part p ON p.p_partkey = s.product_id GROUP BY 1, 2""")
def q_enrich_total_dims(v: Views):
    segments = v.t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    brands = v.t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    return J.enrich_total(v.v_sale, ["segment", "brand"], "price",
                          dims=[(segments, ["customer_id"]), (brands, ["product_id"])])


@register("first_after", "W21", """
SELECT customer_id, order_date, product_id, product_name FROM (
  SELECT s.customer_id, s.order_date, s.product_id, s.product_name,
         rank() OVER (PARTITION BY s.customer_id ORDER BY s.order_date) AS r
  FROM v_sale s JOIN v_member m ON m.customer_id = s.customer_id WHERE s.order_date >= m.join_date) t
WHERE r = 1""")
def q_first_after(v: Views):
    return J.first_after(v.v_sale, v.v_member).select("customer_id", "order_date", "product_id", "product_name")


@register("last_before", "W23", """
SELECT customer_id, order_date, product_id, product_name FROM (
  SELECT s.customer_id, s.order_date, s.product_id, s.product_name,
         rank() OVER (PARTITION BY s.customer_id ORDER BY s.order_date DESC) AS r
  FROM v_sale s JOIN v_member m ON m.customer_id = s.customer_id WHERE s.order_date < m.join_date) t
WHERE r = 1""")
def q_last_before(v: Views):
    return J.last_before(v.v_sale, v.v_member).select("customer_id", "order_date", "product_id", "product_name")


@register("total_before", "W24", """
SELECT s.customer_id, count(*) AS n_items, CAST(sum(s.price) AS DECIMAL(38,2)) AS total_amount
FROM v_sale s JOIN v_member m ON m.customer_id = s.customer_id AND m.join_date > s.order_date
GROUP BY s.customer_id""")
def q_total_before(v: Views):
    return J.total_before(v.v_sale, v.v_member)


@register("flag_since", "W25", """
SELECT s.customer_id, s.order_date, s.order_id, s.line_no, s.product_name, s.price,
       CASE WHEN s.order_date >= m.join_date THEN 'Y' ELSE 'N' END AS member
FROM v_sale s LEFT JOIN v_member m ON m.customer_id = s.customer_id""")
def q_flag_since(v: Views):
    return J.flag_since(v.v_sale, v.v_member).select(
        "customer_id", "order_date", "order_id", "line_no", "product_name", "price", "member")


@register("rank_flagged", "W26", """
SELECT customer_id, order_date, order_id, line_no, product_id, product_name, price, member,
       CASE WHEN member = 'Y' THEN CAST(row_number() OVER (PARTITION BY customer_id, member
            ORDER BY order_date, order_id, line_no, product_id, price) AS INTEGER) END AS ranking
FROM (SELECT s.*, CASE WHEN s.order_date >= m.join_date THEN 'Y' ELSE 'N' END AS member
      FROM v_sale s LEFT JOIN v_member m ON m.customer_id = s.customer_id) t""")
def q_rank_flagged(v: Views):
    return J.rank_flagged(v.v_sale, v.v_member, SALE_ORDER).select(
        "customer_id", "order_date", "order_id", "line_no", "product_id", "product_name", "price",
        "member", "ranking")


@register("semi_join_keys", "W27", """
SELECT p.page_name, count(*) AS n_purchases
FROM v_event e JOIN v_page p ON p.page_id = e.page_id
WHERE e.visit_id IN (SELECT visit_id FROM v_event WHERE event_type = 3)
  AND p.product_id > 0 AND e.event_type = 2
GROUP BY p.page_name""")
def q_semi_join_keys(v: Views):
    buyers = v.v_event.where(F.col("event_type") == 3)
    adds = v.v_event.where(F.col("event_type") == 2)
    return (J.semi_join_keys(adds, buyers, ["visit_id"])
            .join(v.v_page.where(F.col("product_id") > 0), "page_id")
            .groupBy("page_name").agg(F.count(F.lit(1)).alias("n_purchases")))


@register("anti_join_keys", "W28", """
SELECT DISTINCT e.visit_id FROM v_event e
WHERE e.page_id = 12 AND NOT EXISTS (SELECT 1 FROM v_event b WHERE b.event_type = 3 AND b.visit_id = e.visit_id)""")
def q_anti_join_keys(v: Views):
    buyers = v.v_event.where(F.col("event_type") == 3)
    checkout = v.v_event.where(F.col("page_id") == 12).select("visit_id").distinct()
    return J.anti_join_keys(checkout, buyers, ["visit_id"])


@register("missing_in_range", "W29", """
SELECT r.week_number FROM (SELECT CAST(range AS BIGINT) AS week_number FROM range(1, 53)) r
WHERE r.week_number NOT IN (
  SELECT (dayofyear(week_date) + dayofweek(make_date(year(week_date), 1, 1)) - 1) // 7 + 1 FROM v_weekly)""")
def q_missing_in_range(v: Views):
    weeks = v.v_weekly.select(sunday_week("week_date").alias("week_number"))
    return J.missing_in_range(weeks, "week_number", 1, 52)


@register("missing_runs", "W29", """
SELECT user_id + 1 AS first_missing, n - 1 AS last_missing, n - user_id - 1 AS n_missing
FROM (SELECT user_id, lead(user_id) OVER (ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events) d) t
WHERE n - user_id > 1""")
def q_missing_runs(v: Views):
    return missing_runs(v.t.events, "user_id")


@register("missing_days", "W29", """
SELECT CAST(d + 1 AS DATE) AS first_missing, CAST(n - 1 AS DATE) AS last_missing, CAST(n - d - 1 AS BIGINT) AS n_missing
FROM (SELECT d, lead(d) OVER (ORDER BY d) AS n FROM (SELECT DISTINCT order_date AS d FROM v_sale WHERE product_id = 7) x) t
WHERE n - d > 1""")
def q_missing_days(v: Views):
    """Stretches of days on which a product was not sold."""
    return missing_runs(v.v_sale.where(F.col("product_id") == 7), "order_date")


@register("interval_join", "W22", """
SELECT e.event_id, e.event_time, c.campaign_name
FROM v_event e LEFT JOIN v_campaign c ON e.event_time BETWEEN c.start_date AND c.end_date""")
def q_interval_join(v: Views):
    return J.interval_join(v.v_event, v.v_campaign, "event_time", "start_date", "end_date").select(
        "event_id", "event_time", "campaign_name")
