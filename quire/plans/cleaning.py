"""Catalogue entries for cleaning, calendar and load operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import calendar as cal
from quire.functions.text import split_int_list
from quire.operators import cleaning as C
from quire.plans.registry import register
from quire.sources.sinks import append_rows, co_partition, materialize
from quire.sources.tables import load_table
from quire.sources.views import Views

ANCHOR = "1998-06-15"  # the before/after anchor of the weekly fixture (a Monday)

# DuckDB spellings used by several oracles
NUM_RE = r"'^\s*(-?[0-9]+(\.[0-9]+)?)'"
TSQL_WEEK = "CAST((dayofyear({d}) + dayofweek(make_date(year({d}), 1, 1)) - 1) // 7 + 1 AS INTEGER)"
SUNDAY_START = "(CAST({d} AS DATE) - CAST(dayofweek({d}) AS INTEGER))"
WEEK_OFFSET = ("CAST(date_diff('day', " + SUNDAY_START.format(d="{d}") + ", "
               + SUNDAY_START.format(d="DATE '" + ANCHOR + "'") + ") // 7 AS INTEGER)")


def tsql_week_sql(d: str) -> str:
    return TSQL_WEEK.format(d=d)


def week_offset_sql(d: str) -> str:
    return WEEK_OFFSET.format(d=d)


@register("load_table", "W01", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders""")
def q_load_table(v: Views):
    schema = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz")
    return load_table(v.spark, v.t.path("orders"), schema=schema)


@register("normalize_missing", "W02", """
SELECT order_id,
       CASE WHEN pickup_time IN ('null', '') THEN NULL ELSE pickup_time END AS pickup_time,
       CASE WHEN distance IN ('null', '') THEN NULL ELSE distance END AS distance,
       CASE WHEN duration IN ('null', '') THEN NULL ELSE duration END AS duration,
       CASE WHEN cancellation IN ('null', '') THEN NULL ELSE cancellation END AS cancellation
FROM v_dirty""")
def q_normalize_missing(v: Views):
    cols = ["pickup_time", "distance", "duration", "cancellation"]
    return C.normalize_missing(v.v_dirty, cols).select("order_id", *cols)


@register("strip_unit_cast", "W03", f"""
SELECT order_id,
       TRY_CAST(CASE WHEN pickup_time IN ('null', '') THEN NULL ELSE pickup_time END AS TIMESTAMP) AS pickup_time,
       TRY_CAST(NULLIF(regexp_extract(distance, {NUM_RE}, 1), '') AS DECIMAL(10,2)) AS distance,
       TRY_CAST(NULLIF(regexp_extract(duration, {NUM_RE}, 1), '') AS INTEGER) AS duration
FROM v_dirty""")
def q_strip_unit_cast(v: Views):
    return C.clean_deliveries(v.v_dirty).select("order_id", "pickup_time", "distance", "duration")


@register("parse_short_date", "W04", """
SELECT week_text,
       make_date(CASE WHEN CAST(split_part(week_text, '/', 3) AS INTEGER) > 49 THEN 1900 ELSE 2000 END
                 + CAST(split_part(week_text, '/', 3) AS INTEGER),
                 CAST(split_part(week_text, '/', 2) AS INTEGER), CAST(split_part(week_text, '/', 1) AS INTEGER)) AS week_date,
       region, platform, segment, customer_type, transactions, sales
FROM (SELECT strftime(week_date, '%-d/%-m/%y') AS week_text, * EXCLUDE (week_date) FROM v_weekly) t""")
def q_parse_short_date(v: Views):
    raw = v.v_weekly.withColumn("week_text", cal.format_short_date("week_date")).drop("week_date")
    return C.parse_short_date(raw, "week_text", out="week_date").select(
        "week_text", "week_date", "region", "platform", "segment", "customer_type", "transactions", "sales")


@register("calendar_parts", "W05", f"""
SELECT txn_id, d AS txn_date, CAST(month(d) AS INTEGER) AS month_number, CAST(year(d) AS INTEGER) AS calendar_year,
       CAST(isodow(d) AS INTEGER) AS iso_weekday, CAST(dayofweek(d) + 1 AS INTEGER) AS sunday_weekday,
       CAST(weekofyear(d) AS INTEGER) AS iso_week, {tsql_week_sql('d')} AS week_number,
       {week_offset_sql('d')} AS week_offset
FROM (SELECT txn_id, txn_date AS d FROM v_txn) t""")
def q_calendar_parts(v: Views):
    return C.calendar_parts(v.v_txn.select("txn_id", "txn_date"), "txn_date", anchor=ANCHOR)


@register("count_by_hour", "W05", """
SELECT CAST(hour(event_time) AS INTEGER) AS hour_of_day, count(*) AS volume FROM v_event GROUP BY 1""")
def q_count_by_hour(v: Views):
    return v.v_event.groupBy(F.hour("event_time").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("volume"))


@register("count_by_iso_weekday", "W05", """
SELECT CAST(isodow(event_time) AS INTEGER) AS day_of_week, count(*) AS volume FROM v_event GROUP BY 1""")
def q_count_by_iso_weekday(v: Views):
    return (v.v_event.groupBy(cal.iso_weekday("event_time").alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("volume")))


@register("count_by_iso_week", "W05", """
SELECT CAST(weekofyear(join_date) AS INTEGER) AS iso_week, count(*) AS n_members FROM v_member GROUP BY 1""")
def q_count_by_iso_week(v: Views):
    return (v.v_member.groupBy(cal.iso_week("join_date").alias("iso_week"))
            .agg(F.count(F.lit(1)).alias("n_members")))


@register("week_offset", "W05", f"""
SELECT week_date, region, platform, segment, customer_type, {week_offset_sql('week_date')} AS week_offset FROM v_weekly""")
def q_week_offset(v: Views):
    return (v.v_weekly.select("week_date", "region", "platform", "segment", "customer_type")
            .withColumn("week_offset", cal.sunday_weeks_between("week_date", F.lit(ANCHOR).cast("date"))))


@register("decode_segment", "W06", """
SELECT week_date, region, platform, segment, customer_type,
       CASE right(segment, 1) WHEN '1' THEN 'Young Adults' WHEN '2' THEN 'Middle Aged' WHEN '3' THEN 'Retirees'
            WHEN '4' THEN 'Retirees' ELSE 'Unknown' END AS age_band,
       CASE left(segment, 1) WHEN 'C' THEN 'Couples' WHEN 'F' THEN 'Families' ELSE 'Unknown' END AS demographic
FROM v_weekly""")
def q_decode_segment(v: Views):
    return C.decode_segment(v.v_weekly).select(
        "week_date", "region", "platform", "segment", "customer_type", "age_band", "demographic")


@register("add_row_id", "W07", """
SELECT order_id, line_no, product_id, price,
       CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_no, product_id, price) AS INTEGER) AS item_no
FROM v_sale""")
def q_add_row_id(v: Views):
    return C.add_row_id(v.v_sale.select("order_id", "line_no", "product_id", "price"),
                        ["order_id"], ["line_no", "product_id", "price"])


@register("safe_ratio", "W08", """
SELECT week_date, region, platform, segment, customer_type, sales, transactions,
       CAST(CAST((200 * CAST(sales AS HUGEINT) + transactions) // (2 * transactions) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(10,2)) AS avg_transaction,
       CAST(sales // transactions AS BIGINT) AS avg_transaction_int
FROM v_weekly""")
def q_safe_ratio(v: Views):
    return C.safe_ratio(v.v_weekly, "sales", "transactions", out_int="avg_transaction_int").select(
        "week_date", "region", "platform", "segment", "customer_type", "sales", "transactions",
        "avg_transaction", "avg_transaction_int")


@register("check_constraints", "W09", """
SELECT 'rating_between_1_and_5' AS rule,
       CAST(count(*) FILTER (WHERE NOT coalesce(rating BETWEEN 1 AND 5, true)) AS BIGINT) AS violations FROM v_rating
UNION ALL
SELECT 'pk_order_id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM v_rating GROUP BY order_id HAVING count(*) > 1) a
UNION ALL
SELECT 'unique_order_runner_customer', CAST(coalesce(sum(n), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM v_rating GROUP BY order_id, runner_id, customer_id HAVING count(*) > 1) b""")
def q_check_constraints(v: Views):
    return C.check_constraints(
        v.v_rating,
        unique={"pk_order_id": ["order_id"],
                "unique_order_runner_customer": ["order_id", "runner_id", "customer_id"]},
        checks={"rating_between_1_and_5": F.col("rating").between(1, 5)})


@register("rejected_rows", "W09", """
SELECT order_id, runner_id, customer_id, rating, 'rating_between_1_and_5' AS rule FROM v_rating
WHERE NOT (rating BETWEEN 1 AND 5)
UNION ALL
SELECT order_id, runner_id, customer_id, rating, 'pk_order_id' FROM (
  SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM v_rating) t WHERE n > 1""")
def q_rejected_rows(v: Views):
    return C.rejected_rows(v.v_rating, unique={"pk_order_id": ["order_id"]},
                           checks={"rating_between_1_and_5": F.col("rating").between(1, 5)})


@register("materialize", "W10", """
SELECT txn_id, customer_id, txn_date, txn_type,
       CASE WHEN txn_type = 'deposit' THEN txn_amount ELSE -txn_amount END AS signed_amount,
       CAST(year(txn_date) AS INTEGER) AS txn_year
FROM v_txn""")
def q_materialize(v: Views):
    signed = v.v_txn.select(
        "txn_id", "customer_id", "txn_date", "txn_type",
        F.when(F.col("txn_type") == "deposit", F.col("txn_amount")).otherwise(-F.col("txn_amount"))
        .alias("signed_amount"),
        F.year("txn_date").alias("txn_year"))
    return materialize(signed, "signed_ledger", partition_by=["txn_year"])


@register("append_rows", "W11", """
SELECT item_name, toppings FROM v_recipe
UNION ALL
SELECT 'SUPREME', string_agg(CAST(m AS VARCHAR), ', ' ORDER BY m) FROM (
  SELECT DISTINCT TRY_CAST(trim(x) AS INTEGER) AS m
  FROM (SELECT unnest(string_split(extras, ',')) AS x FROM v_item WHERE extras NOT IN ('null', '')) a
  WHERE TRY_CAST(trim(x) AS INTEGER) IS NOT NULL) b""")
def q_append_rows(v: Views):
    # the new row lists every member id that was ever added as an extra
    members = (v.v_item_lines.select(F.explode(split_int_list("extras")).alias("m"))
               .where(F.col("m").isNotNull()).distinct())
    # distinct members are bounded by the member dimension, so one small group
    supreme = members.agg(F.array_join(F.array_sort(F.collect_list("m")), ", ").alias("toppings")) \
        .select(F.lit("SUPREME").alias("item_name"), "toppings")
    return append_rows(v.v_recipe, supreme)


@register("co_partition", "W10", """
SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, count(*) AS n_lines,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS line_total
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_custkey""")
def q_co_partition(v: Views):
    return order_totals(*co_partitioned_orders(v))


def co_partitioned_orders(v: Views, buckets: int = 16):
    """Orders and their lines as catalogue tables with the same buckets of the order id."""
    orders = v.t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    lines = v.t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return (co_partition(orders, "quire_orders_by_id", ["order_id"], buckets),
            co_partition(lines, "quire_lines_by_order", ["order_id"], buckets))


def order_totals(orders, lines):
    return (orders.join(lines, "order_id").groupBy("order_id", "customer_id")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("price").cast("decimal(38,2)").alias("line_total")))
