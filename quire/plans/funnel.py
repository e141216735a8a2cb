"""Catalogue entries for points, funnel, visit summary and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.numeric import percent
from quire.operators import funnel as Fn
from quire.plans.common import pct_sql
from quire.plans.registry import register
from quire.sources.views import Views

BONUS_ITEM = "PROMO"     # the item earning double points
CUTOFF = "1998-01-31"    # last day counted by the first-week points question
CHECKOUT_PAGE = 12

POINTS_RATE_SQL = "CASE WHEN {cond} THEN price * 20 ELSE price * 10 END"

FUNNEL_SQL = """(
  SELECT * FROM (
    SELECT p.page_name, p.product_category,
           count(*) FILTER (WHERE d.event_type = 1) AS product_views,
           count(*) FILTER (WHERE d.event_type = 2) AS product_added_to_cart,
           count(*) FILTER (WHERE d.event_type = 2 AND b.visit_id IS NULL) AS total_abandoned_carts,
           count(*) FILTER (WHERE d.event_type = 2 AND b.visit_id IS NOT NULL) AS total_purchases
    FROM (SELECT DISTINCT visit_id, page_id, event_type FROM v_event) d
    JOIN v_page p ON p.page_id = d.page_id
    LEFT JOIN (SELECT DISTINCT visit_id FROM v_event WHERE event_type = 3) b ON b.visit_id = d.visit_id
    WHERE p.product_category IS NOT NULL GROUP BY 1, 2) x
  WHERE total_abandoned_carts > 0 AND total_purchases > 0)"""


def funnel(v: Views):
    return Fn.item_funnel(v.v_event, v.v_page)


@register("item_points", "W55", f"""
SELECT customer_id, CAST(sum({POINTS_RATE_SQL.format(cond=f"product_name = '{BONUS_ITEM}'")}) AS DECIMAL(38,2)) AS points
FROM v_sale GROUP BY customer_id""")
def q_item_points(v: Views):
    return Fn.item_points(v.v_sale, "customer_id", "price", "product_name", BONUS_ITEM)


@register("join_week_points", "W55", f"""
SELECT s.customer_id,
       CAST(sum(CASE WHEN date_diff('day', m.join_date, s.order_date) BETWEEN 0 AND 6 OR s.product_name = '{BONUS_ITEM}'
                     THEN s.price * 20 ELSE s.price * 10 END) AS DECIMAL(38,2)) AS points
FROM v_sale s JOIN v_member m ON m.customer_id = s.customer_id
WHERE s.order_date <= DATE '{CUTOFF}' GROUP BY s.customer_id""")
def q_join_week_points(v: Views):
    return Fn.join_week_points(v.v_sale, v.v_member, "customer_id", "price", "product_name", BONUS_ITEM, CUTOFF)


@register("item_funnel", "W56", f"SELECT * FROM {FUNNEL_SQL} f")
def q_item_funnel(v: Views):
    return funnel(v)


@register("category_funnel", "W56", f"""
SELECT product_category, CAST(sum(product_views) AS BIGINT) AS product_views,
       CAST(sum(product_added_to_cart) AS BIGINT) AS product_added_to_cart,
       CAST(sum(total_abandoned_carts) AS BIGINT) AS total_abandoned_carts,
       CAST(sum(total_purchases) AS BIGINT) AS total_purchases
FROM {FUNNEL_SQL} f GROUP BY product_category""")
def q_category_funnel(v: Views):
    out = Fn.category_funnel(funnel(v))
    return out.select("product_category", *[F.col(m).cast("bigint").alias(m) for m in Fn.FUNNEL_MEASURES])


@register("funnel_leaders", "W56", f"""
WITH f AS {FUNNEL_SQL}
SELECT page_name AS product, product_views, product_added_to_cart, total_purchases FROM f
WHERE page_name IN ((SELECT page_name FROM f ORDER BY product_views DESC, page_name LIMIT 1),
                    (SELECT page_name FROM f ORDER BY product_added_to_cart DESC, page_name LIMIT 1),
                    (SELECT page_name FROM f ORDER BY total_purchases DESC, page_name LIMIT 1))""")
def q_funnel_leaders(v: Views):
    return Fn.funnel_leaders(funnel(v))


@register("top_abandoned", "W56", f"""
SELECT page_name AS product, total_abandoned_carts FROM {FUNNEL_SQL} f
ORDER BY total_abandoned_carts DESC, page_name LIMIT 1""")
def q_top_abandoned(v: Views):
    return (Fn.top_by(funnel(v), "total_abandoned_carts", "page_name")
            .select(F.col("page_name").alias("product"), "total_abandoned_carts"))


@register("best_conversion", "W56", f"""
SELECT page_name AS product, {pct_sql('total_purchases', 'product_views', 4)} AS view_to_purchase_perc
FROM {FUNNEL_SQL} f ORDER BY view_to_purchase_perc DESC, page_name LIMIT 1""")
def q_best_conversion(v: Views):
    f = funnel(v).withColumn("view_to_purchase_perc", percent("total_purchases", "product_views", 4))
    return (Fn.top_by(f, "view_to_purchase_perc", "page_name")
            .select(F.col("page_name").alias("product"), "view_to_purchase_perc"))


@register("mean_conversion", "W56", f"""
SELECT round(avg(product_added_to_cart * 100.0 / product_views), 4) AS view_to_cart_add_perc,
       round(avg(total_purchases * 100.0 / product_added_to_cart), 4) AS cart_add_to_purchase_perc
FROM {FUNNEL_SQL} f""")
def q_mean_conversion(v: Views):
    return Fn.conversion_means(funnel(v))


VISIT_SUMMARY_SQL = """
SELECT s.user_id, s.visit_id, s.visit_start_time, s.page_views, s.cart_adds, s.purchase, c.campaign_name,
       s.impression, s.click
FROM (SELECT user_id, visit_id, min(event_time) AS visit_start_time,
             count(*) FILTER (WHERE event_type = 1) AS page_views, count(*) FILTER (WHERE event_type = 2) AS cart_adds,
             CAST(max(CASE WHEN event_type = 3 THEN 1 ELSE 0 END) AS INTEGER) AS purchase,
             count(*) FILTER (WHERE event_type = 4) AS impression, count(*) FILTER (WHERE event_type = 5) AS click
      FROM v_event GROUP BY user_id, visit_id) s
LEFT JOIN v_campaign c ON s.visit_start_time BETWEEN c.start_date AND c.end_date"""


@register("visit_summary", "W57", VISIT_SUMMARY_SQL)
def q_visit_summary(v: Views):
    return Fn.visit_summary(v.v_event, v.v_campaign)


@register("top_k", "W58", """
SELECT p.page_name, count(*) AS no_of_page_view FROM v_event e JOIN v_page p ON p.page_id = e.page_id
WHERE e.event_type = 1 GROUP BY p.page_name ORDER BY no_of_page_view DESC, p.page_name LIMIT 3""")
def q_top_k(v: Views):
    views = v.v_event.where(F.col("event_type") == Fn.VIEW).join(v.v_page, "page_id")
    return Fn.top_k(views, ["page_name"], k=3, name="no_of_page_view")


@register("viewed_without_buying", "W58", f"""
SELECT {pct_sql('n', 'd')} AS checkout_without_purchase_perc FROM
  (SELECT count(*) AS n FROM (SELECT DISTINCT e.visit_id, e.page_id, e.event_type FROM v_event e
                              WHERE e.page_id = {CHECKOUT_PAGE} AND NOT EXISTS (
                                SELECT 1 FROM v_event b WHERE b.event_type = 3 AND b.visit_id = e.visit_id)) x) a,
  (SELECT count(DISTINCT visit_id) AS d FROM v_event WHERE page_id = {CHECKOUT_PAGE}) b""")
def q_viewed_without_buying(v: Views):
    return Fn.viewed_without_buying(v.v_event, CHECKOUT_PAGE)


@register("visit_summary_stream", "W57", VISIT_SUMMARY_SQL)
def q_visit_summary_stream(v: Views):
    """W57 computed incrementally: the event file replayed as a stream (available-now)."""
    from quire.streaming.visits import run_visit_summary
    return run_visit_summary(v.spark, v.t.path("events"), v.v_campaign)


@register("top_k_by_sketch", "W58", """
SELECT part_id, n FROM (SELECT l_partkey AS part_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY l_partkey) t
WHERE r <= 20""")
def q_top_k_by_sketch(v: Views):
    """The parts on most order lines, ties with the twentieth kept."""
    return Fn.top_k_by_sketch(v.t.lineitem.select(F.col("l_partkey").alias("part_id")), "part_id", 20)
