"""Catalogue entries for the window and state operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions.calendar import minutes_between
from quire.functions.numeric import exact_mean_of_units
from quire.operators import windows as Wn
from quire.operators.balances import merge_late, read_balances, store_balances
from quire.plans.cleaning import NUM_RE
from quire.plans.common import DELIVERED_SQL, delivered_orders, deliveries, pct_sql, weekly
from quire.plans.joins import SALE_ORDER
from quire.plans.registry import register
from quire.session import checkpoint_dir
from quire.sources.views import OPEN_END, Views

SUB_ORDER = ["start_date", "event_id"]
YEAR = 1997            # year filter of the transition questions
ASOF = "1998-12-31"    # as-of date of the plan-mix question
HORIZON = "2001-12-31"  # last day of the payment schedule (the data ends in 2001)

# plan ids of the subscription fixture: 0 trial, 1 basic monthly, 2 pro monthly, 3 pro annual, 4 churn
TRIAL, BASIC, PRO, ANNUAL, CHURN = 0, 1, 2, 3, 4

N_CUST_SQL = "(SELECT count(DISTINCT customer_id) FROM v_sub)"
SEQ_SQL = """(SELECT *, row_number() OVER w AS rn, lag(plan_id) OVER w AS prev_state,
                     lead(plan_id) OVER w AS next_state, lead(start_date) OVER w AS next_date
              FROM v_sub WINDOW w AS (PARTITION BY customer_id ORDER BY start_date, event_id))"""
SIGNED_SQL = "(SELECT *, CASE WHEN txn_type = 'deposit' THEN txn_amount ELSE -txn_amount END AS signed_amount FROM v_txn)"
MONTHLY_SQL = f"""(SELECT customer_id, month, CAST(mb AS DECIMAL(38,2)) AS monthly_balance,
                   CAST(sum(mb) OVER (PARTITION BY customer_id ORDER BY month) AS DECIMAL(38,2)) AS closing_balance
                   FROM (SELECT customer_id, CAST(date_trunc('month', txn_date) AS DATE) AS month, sum(signed_amount) AS mb
                         FROM {SIGNED_SQL} s GROUP BY 1, 2) m)"""
RUNNING_SQL = f"""(SELECT customer_id, txn_id, txn_date, txn_type, signed_amount,
                   CAST(sum(signed_amount) OVER (PARTITION BY customer_id ORDER BY txn_date) AS DECIMAL(38,2)) AS running_balance
                   FROM {SIGNED_SQL} s)"""
DELIV_SQL = f"""(SELECT order_id, runner_id, customer_id, order_time,
                 TRY_CAST(CASE WHEN pickup_time IN ('null', '') THEN NULL ELSE pickup_time END AS TIMESTAMP) AS pk,
                 TRY_CAST(NULLIF(regexp_extract(distance, {NUM_RE}, 1), '') AS DECIMAL(10,2)) AS dist,
                 TRY_CAST(NULLIF(regexp_extract(duration, {NUM_RE}, 1), '') AS INTEGER) AS dur,
                 {DELIVERED_SQL} AS delivered
                 FROM v_dirty)"""
SPEED_SQL = ("CAST(CAST((2 * 60 * CAST(dist * 100 AS BIGINT) + dur) // (2 * dur) AS DECIMAL(38,0)) * 0.01"
             " AS DECIMAL(12,2))")


def signed_txn(v: Views):
    return Wn.signed(v.v_txn)


@register("first_per_key", "W42", """
SELECT customer_id, order_date, order_id, line_no, product_id, product_name, price FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id, line_no, product_id, price) AS rn
  FROM v_sale) t WHERE rn = 1""")
def q_first_per_key(v: Views):
    return Wn.first_per_key(v.v_sale, "customer_id", SALE_ORDER,
                            ["order_date", "order_id", "line_no", "product_id", "product_name", "price"])


@register("top_by_count_per_key", "W43", """
SELECT customer_id, product_name, n FROM (
  SELECT customer_id, product_name, count(*) AS n, rank() OVER (PARTITION BY customer_id ORDER BY count(*) DESC) AS r
  FROM v_sale GROUP BY customer_id, product_name) t WHERE r = 1""")
def q_top_by_count_per_key(v: Views):
    return Wn.top_by_count_per_key(v.v_sale, "customer_id", "product_name")


@register("nth_state", "W44", f"""
SELECT plan_id, count(*) AS n_customers, {pct_sql('count(*)', N_CUST_SQL)} AS percent
FROM {SEQ_SQL} s WHERE rn = 2 GROUP BY plan_id""")
def q_nth_state(v: Views):
    return Wn.nth_state(v.v_sub, "customer_id", SUB_ORDER, 2)


@register("immediate_transition_share", "W45", f"""
SELECT n AS n_customers, {pct_sql('n', N_CUST_SQL)} AS percent FROM (
  SELECT count(*) AS n FROM {SEQ_SQL} s WHERE prev_state = {TRIAL} AND rn = 2 AND plan_id = {CHURN}) t""")
def q_immediate_transition_share(v: Views):
    return Wn.immediate_transition_share(v.v_sub, "customer_id", SUB_ORDER, TRIAL, CHURN)


@register("later_state_in_year", "W45", f"""
SELECT count(DISTINCT customer_id) AS n_customers FROM {SEQ_SQL} s
WHERE rn > 1 AND plan_id = {ANNUAL} AND year(start_date) = {YEAR}""")
def q_later_state_in_year(v: Views):
    return Wn.later_state_in_year(v.v_sub, "customer_id", SUB_ORDER, ANNUAL, YEAR)


@register("downgrade_count", "W45", f"""
SELECT count(*) AS n_downgrades FROM {SEQ_SQL} s
WHERE plan_id = {PRO} AND next_state = {BASIC} AND year(next_date) = {YEAR}""")
def q_downgrade_count(v: Views):
    return Wn.downgrade_count(v.v_sub, "customer_id", SUB_ORDER, PRO, BASIC, YEAR)


@register("state_asof_written", "W46", f"""
WITH u AS (SELECT customer_id, plan_id FROM v_sub WHERE plan_id NOT IN ({TRIAL}, {CHURN}) AND start_date < DATE '{ASOF}'
           UNION
           SELECT customer_id, plan_id FROM v_sub WHERE plan_id = {TRIAL} AND start_date BETWEEN DATE '{ASOF}' - 6 AND DATE '{ASOF}')
SELECT plan_id, count(DISTINCT customer_id) AS n_customers,
       {pct_sql('count(DISTINCT customer_id)', '(SELECT count(*) FROM u)')} AS percent
FROM u GROUP BY plan_id""")
def q_state_asof_written(v: Views):
    return Wn.state_asof_written(v.v_sub, "customer_id", ASOF)


@register("state_asof_latest", "W46", f"""
WITH l AS (SELECT customer_id, plan_id FROM (
             SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY start_date DESC, event_id DESC) AS rn
             FROM v_sub WHERE start_date <= DATE '{ASOF}') t WHERE rn = 1)
SELECT plan_id, count(*) AS n_customers, {pct_sql('count(*)', '(SELECT count(*) FROM l)')} AS percent
FROM l GROUP BY plan_id""")
def q_state_asof_latest(v: Views):
    return Wn.state_asof_latest(v.v_sub, "customer_id", ASOF, SUB_ORDER)


DAYS_SQL = f"""(SELECT d FROM (
  SELECT customer_id, date_diff('day', min(start_date) FILTER (WHERE plan_id = {TRIAL}),
                                min(start_date) FILTER (WHERE plan_id = {ANNUAL})) AS d
  FROM v_sub GROUP BY customer_id) x WHERE d > 0)"""


@register("days_between_states", "W47", f"""
SELECT round(avg(CAST(d AS DOUBLE)), 4) AS avg_days, count(*) AS n_customers FROM {DAYS_SQL} t""")
def q_days_between_states(v: Views):
    return Wn.avg_days_between_states(v.v_sub, "customer_id", TRIAL, ANNUAL)


@register("bucket_histogram", "W48", f"""
WITH d AS {DAYS_SQL},
     b AS (SELECT CAST(unnest(range(0, (SELECT max(d) // 30 FROM d) + 1)) AS INTEGER) AS k)
SELECT k * 30 AS r_from, k * 30 + 29 AS r_to, round(avg(CAST(d.d AS DOUBLE)), 4) AS average_days,
       count(d.d) AS customer_count
FROM b LEFT JOIN d ON d.d // 30 = b.k GROUP BY k""")
def q_bucket_histogram(v: Views):
    return Wn.bucket_histogram(Wn.days_between_states(v.v_sub, "customer_id", TRIAL, ANNUAL), "days", 30)


@register("expand_schedule", "W49", f"""
WITH s AS (SELECT customer_id, plan_id, event_id, start_date, price,
                  lead(start_date) OVER (PARTITION BY customer_id ORDER BY start_date, event_id) AS nxt
           FROM v_sub WHERE plan_id <> {TRIAL} AND start_date <= DATE '{HORIZON}'),
     e AS (SELECT *, CASE WHEN plan_id = {ANNUAL} THEN start_date WHEN plan_id = {CHURN} THEN NULL
                          ELSE coalesce(nxt, DATE '{HORIZON}') END AS en FROM s),
     p AS (SELECT *, CAST(start_date + to_months(CAST(i AS INTEGER)) AS DATE) AS payment_date FROM (
             SELECT e.*, unnest(range(0, date_diff('month', start_date, en) + 2)) AS i FROM e WHERE en IS NOT NULL) x),
     q AS (SELECT * FROM p WHERE (i = 0 AND start_date <= en) OR (i >= 1 AND payment_date < en))
SELECT customer_id, plan_id, payment_date,
       CAST(CASE WHEN lag(plan_id) OVER w <> plan_id AND date_diff('day', lag(payment_date) OVER w, payment_date) < 30
                 THEN price - lag(price) OVER w ELSE price END AS DECIMAL(7,2)) AS amount,
       CAST(rank() OVER (PARTITION BY customer_id ORDER BY payment_date) AS INTEGER) AS payment_order
FROM q WINDOW w AS (PARTITION BY customer_id ORDER BY payment_date, plan_id, event_id, i)""")
def q_expand_schedule(v: Views):
    return Wn.expand_schedule(v.v_sub, HORIZON)


@register("period_growth", "W50", """
WITH m AS (SELECT CAST(year(start_date) AS INTEGER) AS year, CAST(month(start_date) AS INTEGER) AS month, count(*) AS cur
           FROM v_sub WHERE plan_id <> 4 GROUP BY 1, 2)
SELECT year, month, cur AS current_number_of_customers, lag(cur) OVER w AS past_number_of_customers,
       CAST((100 * (cur - lag(cur) OVER w)) // lag(cur) OVER w AS VARCHAR) || '%' AS growth
FROM m WINDOW w AS (ORDER BY year, month)""")
def q_period_growth(v: Views):
    return Wn.period_growth(v.v_sub.where(F.col("plan_id") != CHURN), "start_date")


@register("period_balance", "W51", f"SELECT * FROM {MONTHLY_SQL} t")
def q_period_balance(v: Views):
    pb = Wn.period_balance(signed_txn(v), "customer_id", "txn_date", "signed_amount")
    return pb.select("customer_id", "month", F.col("monthly_balance").cast("decimal(38,2)").alias("monthly_balance"),
                     F.col("closing_balance").cast("decimal(38,2)").alias("closing_balance"))


@register("running_balance", "W51", f"SELECT * FROM {RUNNING_SQL} t")
def q_running_balance(v: Views):
    rb = Wn.running_balance(signed_txn(v), "customer_id", "txn_date", "signed_amount")
    return rb.select("customer_id", "txn_id", "txn_date", "txn_type", "signed_amount",
                     F.col("running_balance").cast("decimal(38,2)").alias("running_balance"))


@register("period_end_balance", "W51", f"""
SELECT customer_id, CAST(date_trunc('month', txn_date) AS DATE) AS month,
       CAST(arg_max(running_balance, txn_date) AS DECIMAL(38,2)) AS end_balance
FROM {RUNNING_SQL} r GROUP BY 1, 2""")
def q_period_end_balance(v: Views):
    pe = Wn.period_end_balance(signed_txn(v), "customer_id", "txn_date", "signed_amount")
    return pe.select("customer_id", "month", F.col("end_balance").cast("decimal(38,2)").alias("end_balance"))


@register("balance_growth_share", "W51", f"""
WITH p AS (SELECT *, lag(closing_balance) OVER (PARTITION BY customer_id ORDER BY month) AS prev
           FROM {MONTHLY_SQL} m WHERE closing_balance > 0)
SELECT n AS n_growing, tot AS total_customers, CAST(n * 100 // tot AS BIGINT) AS cust_perc
FROM (SELECT count(DISTINCT customer_id) AS n FROM p WHERE (closing_balance - prev) * 100 >= 6 * prev) a,
     (SELECT count(DISTINCT customer_id) AS tot FROM v_txn) b""")
def q_balance_growth_share(v: Views):
    return Wn.balance_growth_share(signed_txn(v), "customer_id", "txn_date", "signed_amount")


@register("min_avg_max_by", "W30", f"""
SELECT customer_id, min_bal, max_bal,
       CAST(CAST(sign(s) * ((2 * 100 * abs(s) + n) // (2 * n)) AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(38,4)) AS avg_bal
FROM (SELECT customer_id, min(running_balance) AS min_bal, max(running_balance) AS max_bal,
             sum(CAST(running_balance * 100 AS HUGEINT)) AS s, count(running_balance) AS n
      FROM {RUNNING_SQL} r GROUP BY customer_id) a""")
def q_min_avg_max_by(v: Views):
    rb = Wn.running_balance(signed_txn(v), "customer_id", "txn_date", "signed_amount")
    rb = rb.withColumn("running_balance", F.col("running_balance").cast("decimal(38,2)"))
    return Wn.min_avg_max(rb, "customer_id", "running_balance")


@register("elapsed_avg", "W53", f"""
SELECT d.runner_id, round(avg(date_diff('second', d.order_time, d.pk)) / 60.0, 4) AS avg_minutes
FROM v_item i JOIN {DELIV_SQL} d ON d.order_id = i.order_id GROUP BY d.runner_id""")
def q_elapsed_avg(v: Views):
    rows = v.v_item_lines.select("order_id").join(deliveries(v), "order_id")
    # mean of whole seconds (an exact integer sum), then minutes: independent of summation order
    secs = F.timestamp_diff("SECOND", F.col("order_time"), F.col("pickup_time"))
    return rows.groupBy("runner_id").agg(F.round(F.avg(secs) / 60.0, 4).alias("avg_minutes"))


@register("elapsed_with_count", "W53", f"""
SELECT d.order_id, round(date_diff('second', d.order_time, d.pk) / 60.0, 4) AS minutes, count(*) AS no_of_items
FROM v_item i JOIN {DELIV_SQL} d ON d.order_id = i.order_id WHERE d.delivered
GROUP BY d.order_id, d.order_time, d.pk""")
def q_elapsed_with_count(v: Views):
    counts = v.v_item_lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("no_of_items"))
    return (delivered_orders(v).join(counts, "order_id")
            .select("order_id", F.round(minutes_between("order_time", "pickup_time"), 4).alias("minutes"),
                    "no_of_items"))


@register("speed_vs_average", "W53", f"""
SELECT order_id, item_no, runner_id, sp AS order_speed,
       CAST(CAST(sign(s) * ((2 * 100 * abs(s) + c) // (2 * c)) AS DECIMAL(38,0)) * 0.0001 AS DECIMAL(38,4)) AS runner_average,
       hour_of_day
FROM (SELECT *, sum(CAST(sp * 100 AS HUGEINT)) OVER (PARTITION BY runner_id) AS s,
             count(sp) OVER (PARTITION BY runner_id) AS c
      FROM (SELECT i.order_id, i.item_no, d.runner_id, {SPEED_SQL} AS sp, CAST(hour(d.order_time) AS INTEGER) AS hour_of_day
            FROM v_item i JOIN {DELIV_SQL} d ON d.order_id = i.order_id) t) u""")
def q_speed_vs_average(v: Views):
    orders = deliveries(v).select("order_id", "runner_id", Wn.speed("distance", "duration").alias("order_speed"),
                                  F.hour("order_time").alias("hour_of_day"))
    # per-runner mean over item rows = per-order speeds weighted by the order's item count:
    # a partial+final aggregate on un-numbered items (a window over a low-cardinality
    # runner key would put a tenth of all rows in one task)
    n = v.v_item_lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    w = F.when(F.col("order_speed").isNotNull(), F.col("_n"))
    cents = (F.col("order_speed") * 100).cast("decimal(38,0)") * F.col("_n")
    avg = (orders.join(n, "order_id").groupBy("runner_id")
           .agg(exact_mean_of_units(F.sum(cents), F.sum(w)).alias("runner_average")))
    rows = v.v_item.select("order_id", "item_no").join(orders, "order_id")
    return rows.join(avg, "runner_id").select("order_id", "item_no", "runner_id", "order_speed",
                                              "runner_average", "hour_of_day")


@register("delivery_fact", "W53", f"""
SELECT r.customer_id, r.order_id, r.runner_id, r.rating, strftime(d.order_time, '%H:%M:%S') AS order_clock,
       strftime(d.pk, '%H:%M:%S') AS pickup_clock, round(date_diff('second', d.order_time, d.pk) / 60.0, 4) AS preparation_minutes,
       d.dur AS duration, {SPEED_SQL} AS average_speed, c.n AS number_of_items
FROM v_rating r JOIN {DELIV_SQL} d ON d.order_id = r.order_id
JOIN (SELECT order_id, count(*) AS n FROM v_item GROUP BY order_id) c ON c.order_id = r.order_id
WHERE d.delivered""")
def q_delivery_fact(v: Views):
    counts = v.v_item_lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("number_of_items"))
    d = delivered_orders(v).drop("runner_id", "customer_id")
    return (v.v_rating.join(d, "order_id").join(counts, "order_id")
            .select("customer_id", "order_id", "runner_id", "rating",
                    F.date_format("order_time", "HH:mm:ss").alias("order_clock"),
                    F.date_format("pickup_time", "HH:mm:ss").alias("pickup_clock"),
                    F.round(minutes_between("order_time", "pickup_time"), 4).alias("preparation_minutes"),
                    "duration", Wn.speed("distance", "duration").alias("average_speed"), "number_of_items"))


@register("interval_length", "W54", f"""
SELECT round(avg(CAST(date_diff('day', start_date, end_date) AS DOUBLE)), 4) AS average_days
FROM v_node WHERE end_date <> DATE '{OPEN_END}'""")
def q_interval_length(v: Views):
    return Wn.interval_length(v.v_node, "start_date", "end_date", OPEN_END)


# -- W52 before / after ---------------------------------------------------------
BA_ANCHOR = "1998-06-15"        # a Monday; its Sunday-start week number is 25
BA_ANCHOR_WEEK = 25
BA_DIMS = ["region", "platform", "age_band", "demographic", "customer_type"]
_OFF = "(date_diff('day', CAST(week_date AS DATE) - CAST(dayofweek(week_date) AS INTEGER), " \
       f"DATE '{BA_ANCHOR}' - CAST(dayofweek(DATE '{BA_ANCHOR}') AS INTEGER)) // 7)"
_AGE = ("CASE right(segment, 1) WHEN '1' THEN 'Young Adults' WHEN '2' THEN 'Middle Aged' WHEN '3' THEN 'Retirees' "
        "WHEN '4' THEN 'Retirees' ELSE 'Unknown' END")
_DEMO = "CASE left(segment, 1) WHEN 'C' THEN 'Couples' WHEN 'F' THEN 'Families' ELSE 'Unknown' END"
_TSQL_WEEK = "((dayofyear(week_date) + dayofweek(make_date(year(week_date), 1, 1)) - 1) // 7 + 1)"


def _ba_select(keys: str) -> str:
    return (f"SELECT {keys}b AS total_sales_before, a AS total_sales_after, a - b AS change_in_sales, "
            f"{pct_sql('a - b', 'b')} AS percentage_of_change FROM t WHERE a IS NOT NULL AND b IS NOT NULL")


@register("before_after_total", "W52", f"""
WITH w AS (SELECT sales, {_OFF} AS off FROM v_weekly),
     t AS (SELECT CAST(sum(sales) FILTER (WHERE off BETWEEN 1 AND 4) AS BIGINT) AS b,
                  CAST(sum(sales) FILTER (WHERE off BETWEEN -3 AND 0) AS BIGINT) AS a
           FROM w WHERE off BETWEEN -3 AND 4)
{_ba_select('')}""")
def q_before_after_total(v: Views):
    return Wn.before_after(weekly(v), "week_date", BA_ANCHOR, 4)


@register("before_after_by_year", "W52", f"""
WITH w AS (SELECT CAST(year(week_date) AS INTEGER) AS calendar_year, {_TSQL_WEEK} AS wk, sales FROM v_weekly),
     t AS (SELECT calendar_year,
                  CAST(sum(sales) FILTER (WHERE wk BETWEEN {BA_ANCHOR_WEEK - 4} AND {BA_ANCHOR_WEEK - 1}) AS BIGINT) AS b,
                  CAST(sum(sales) FILTER (WHERE wk BETWEEN {BA_ANCHOR_WEEK} AND {BA_ANCHOR_WEEK + 3}) AS BIGINT) AS a
           FROM w WHERE wk BETWEEN {BA_ANCHOR_WEEK - 4} AND {BA_ANCHOR_WEEK + 3} GROUP BY calendar_year)
{_ba_select('calendar_year, ')}""")
def q_before_after_by_year(v: Views):
    return Wn.before_after_by_week_number(weekly(v), "week_number", BA_ANCHOR_WEEK, 4, ["calendar_year"])


@register("before_after_by_dimension", "W52", f"""
WITH w0 AS (SELECT *, {_OFF} AS off, {_AGE} AS age_band, {_DEMO} AS demographic FROM v_weekly),
     d AS ({' UNION ALL '.join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, off, sales FROM w0"
                               for c in BA_DIMS)}),
     t AS (SELECT dimension, value, CAST(sum(sales) FILTER (WHERE off BETWEEN 1 AND 12) AS BIGINT) AS b,
                  CAST(sum(sales) FILTER (WHERE off BETWEEN -11 AND 0) AS BIGINT) AS a
           FROM d WHERE off BETWEEN -11 AND 12 GROUP BY dimension, value)
{_ba_select('dimension, value, ')}""")
def q_before_after_by_dimension(v: Views):
    return Wn.before_after_by_dimension(weekly(v), "week_date", BA_ANCHOR, 12, BA_DIMS)


@register("before_after_label", "W52", f"""
SELECT region, period, CAST(sum(sales) AS BIGINT) AS total_sales FROM (
  SELECT region, sales, CASE WHEN o BETWEEN 1 AND 4 THEN 'before' WHEN o BETWEEN -3 AND 0 THEN 'after' END AS period
  FROM (SELECT region, sales, {_OFF} AS o FROM v_weekly) t) u
WHERE period IS NOT NULL GROUP BY region, period""")
def q_before_after_label(v: Views):
    labelled = Wn.before_after_label(v.v_weekly, "week_date", BA_ANCHOR, 4)
    return (labelled.where(F.col("period").isNotNull()).groupBy("region", "period")
            .agg(F.sum("sales").cast("bigint").alias("total_sales")))


@register("state_mix", "W46", f"""
WITH m AS (SELECT last_day(CAST(range AS DATE)) AS month_end FROM range((SELECT date_trunc('month', min(start_date)) FROM v_sub),
               (SELECT max(start_date) FROM v_sub) + INTERVAL 1 DAY, INTERVAL 1 MONTH)),
     s AS (SELECT m.month_end, v.customer_id, v.plan_id,
                  row_number() OVER (PARTITION BY m.month_end, v.customer_id ORDER BY v.start_date DESC, v.event_id DESC) AS r
           FROM m JOIN v_sub v ON v.start_date <= m.month_end),
     c AS (SELECT month_end, plan_id, count(*) AS n_customers FROM s WHERE r = 1 GROUP BY month_end, plan_id),
     t AS (SELECT *, CAST(sum(n_customers) OVER (PARTITION BY month_end) AS BIGINT) AS total FROM c)
SELECT month_end, plan_id, n_customers, {pct_sql('n_customers', 'total')} AS percent FROM t""")
def q_state_mix(v: Views):
    return Wn.state_mix(v.v_sub, "customer_id", ["start_date", "event_id"])


CUBE_WEEKS = 12


@register("before_after_any_week", "W52", f"""
WITH w0 AS (SELECT *, CAST(week_date - CAST(dayofweek(week_date) AS INT) AS DATE) AS wk, {_AGE} AS age_band, {_DEMO} AS demographic FROM v_weekly),
     d AS ({' UNION ALL '.join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, wk, sales FROM w0" for c in BA_DIMS)}),
     s AS (SELECT dimension, value, wk, sum(sales) AS sales FROM d GROUP BY dimension, value, wk),
     g AS (SELECT dimension, value, CAST(a.range AS DATE) AS week
           FROM (SELECT DISTINCT dimension, value FROM s) v,
                range((SELECT min(wk) FROM s), (SELECT max(wk) FROM s) + INTERVAL 1 DAY, INTERVAL 7 DAY) a),
     t AS (SELECT g.dimension, g.value, g.week,
                  CAST(coalesce(sum(s.sales) FILTER (WHERE s.wk < g.week), 0) AS BIGINT) AS b,
                  CAST(coalesce(sum(s.sales) FILTER (WHERE s.wk >= g.week), 0) AS BIGINT) AS a
           FROM g LEFT JOIN s ON s.dimension = g.dimension AND s.value IS NOT DISTINCT FROM g.value
                AND s.wk >= g.week - {7 * CUBE_WEEKS} AND s.wk < g.week + {7 * CUBE_WEEKS}
           WHERE g.week - {7 * CUBE_WEEKS} >= (SELECT min(wk) FROM s) AND g.week + {7 * (CUBE_WEEKS - 1)} <= (SELECT max(wk) FROM s)
           GROUP BY g.dimension, g.value, g.week)
{_ba_select('dimension, value, week, ')}""")
def q_before_after_any_week(v: Views):
    return Wn.cube_before_after(Wn.prefix_cube(weekly(v), "week_date", BA_DIMS), CUBE_WEEKS)


@register("balances_by_delta", "W51", """
WITH m AS (SELECT customer_id, CAST(date_trunc('month', txn_date) AS DATE) AS month,
                  sum(CASE WHEN txn_type = 'deposit' THEN txn_amount ELSE -txn_amount END) AS net FROM v_txn GROUP BY 1, 2)
SELECT customer_id, month, CAST(net AS DECIMAL(38,2)) AS monthly_balance,
       CAST(sum(net) OVER (PARTITION BY customer_id ORDER BY month) AS DECIMAL(38,2)) AS closing_balance FROM m""")
def q_balances_by_delta(v: Views):
    """The whole ledger in four deliveries: a first load, and three batches that come late, in any order of
    their dates."""
    ledger = Wn.signed(v.v_txn)
    batch = F.pmod(F.xxhash64("txn_id"), F.lit(4))
    path = f"{checkpoint_dir(v.spark).rstrip('/')}/tables/balances-{uuid.uuid4().hex}"
    args = ("customer_id", "txn_date", "signed_amount", 16)
    store_balances(ledger.where(batch == 0), path, *args)
    for i in (1, 2, 3):
        merge_late(v.spark, path, ledger.where(batch == i), *args)
    return read_balances(v.spark, path).select("customer_id", "month", F.col("monthly_balance").cast("decimal(38,2)").alias("monthly_balance"),
                                               F.col("closing_balance").cast("decimal(38,2)").alias("closing_balance"))


# paths of plan changes: a, then never b, then c
PATHS = {"trial to annual without churn": (TRIAL, CHURN, ANNUAL), "basic to churn without pro": (BASIC, PRO, CHURN),
         "annual back to trial without basic": (ANNUAL, BASIC, TRIAL)}


@register("path_counts", "W45", "WITH s AS (SELECT customer_id, plan_id, row_number() OVER (PARTITION BY customer_id ORDER BY start_date, event_id) AS rn FROM v_sub)\n"
          + " UNION ALL ".join(f"""SELECT '{n}' AS path, count(DISTINCT customer_id) FILTER (WHERE plan_id = {c} AND la > coalesce(lb, 0)) AS n_customers
FROM (SELECT customer_id, plan_id, max(CASE WHEN plan_id = {a} THEN rn END) OVER w AS la, max(CASE WHEN plan_id = {b} THEN rn END) OVER w AS lb
      FROM s WINDOW w AS (PARTITION BY customer_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t""" for n, (a, b, c) in PATHS.items()))
def q_path_counts(v: Views):
    return Wn.path_counts(v.v_sub, "customer_id", SUB_ORDER, {n: [(a, []), (c, [b])] for n, (a, b, c) in PATHS.items()})
