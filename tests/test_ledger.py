
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import calendar as cal
from quire.functions.numeric import mean_exact, trunc_div
from quire.functions.text import leading_number, split_int_list
from quire.operators import cleaning as C
from quire.operators import joins as J
from quire.operators import lists as L
from quire.operators import windows as Wn
from quire.sources.views import Views

from conftest import SMALL_SF

D = dt.date.fromisoformat


def test_l1_leading_number(spark):
    df = spark.createDataFrame([("23.4 km",), ("20km",), ("25mins",), ("40",), ("null",), (None,), ("abc",)], "s string")
    got = [r[0] for r in df.select(leading_number("s", "decimal(10,2)")).collect()]
    assert got == [Decimal("23.40"), Decimal("20.00"), Decimal("25.00"), Decimal("40.00"), None, None, None]


def test_l2_three_week_systems(spark):
    df = spark.createDataFrame([("2018-12-31",), ("2021-01-01",), ("2020-01-01",), ("2022-01-01",)], "d string") \
        .select(F.to_date("d").alias("d"))
    got = df.select(cal.sunday_week("d"), cal.iso_week("d")).collect()
    assert [tuple(r) for r in got] == [(53, 1), (1, 53), (1, 1), (1, 52)]
    # Saturday -> Monday crosses one Sunday boundary; Sunday -> Monday none
    pairs = spark.createDataFrame([("2020-06-13", "2020-06-15"), ("2020-06-14", "2020-06-15"),
                                   ("2020-06-15", "2020-06-13")], "a string, b string")
    got = [r[0] for r in pairs.select(cal.sunday_weeks_between(F.to_date("a"), F.to_date("b"))).collect()]
    assert got == [1, 0, -1]


def test_l3_tie_break_makes_first_row_repeatable(spark):
    df = spark.createDataFrame([("A", "2021-01-01", 2), ("A", "2021-01-01", 1)], "k string, d string, p int")
    out = Wn.first_per_key(df, "k", ["d", "p"], ["d", "p"]).collect()
    assert out[0]["p"] == 1


def test_l4_constraints_reported_not_enforced(spark):
    rows = [(1, 1, 1, 4), (2, 1, 1, 2), (2, 3, 4, 5), (3, 2, 2, 9), (3, 2, 2, 1)]
    df = spark.createDataFrame(rows, "order_id int, runner_id int, customer_id int, rating int")
    out = C.check_constraints(df, {"pk": ["order_id"], "uniq": ["order_id", "runner_id", "customer_id"]},
                              {"range": F.col("rating").between(1, 5)})
    assert dict((r.rule, r.violations) for r in out.collect()) == {"pk": 4, "uniq": 2, "range": 1}
    bad = C.rejected_rows(df, {"pk": ["order_id"]}, {"range": F.col("rating").between(1, 5)})
    assert bad.where("rule = 'range'").count() == 1 and bad.where("rule = 'pk'").count() == 4


def test_l5_top_member_ties_by_name(spark):
    df = spark.createDataFrame([("2",), ("1",)], "extras string")
    names = spark.createDataFrame([(1, "Bacon"), (2, "Beef")], "topping_id int, topping_name string")
    assert L.top_list_member(df, "extras", names).first()["topping_name"] == "Bacon"


def test_l6_zip_pads_and_drops_only_double_null(spark):
    df = spark.createDataFrame([(1, "1, 2", "3"), (2, "null", "4"), (3, None, ""), (4, "", None)],
                               "id int, a string, b string")
    got = sorted(tuple(r) for r in L.zip_lists(df, "a", "b", ["id"]).collect())
    assert got == [(1, 1, 3), (1, 2, None), (2, None, 4)]


def test_l8_blank_after_comma(spark):
    df = spark.createDataFrame([("1, 5",), ("1,5",), ("4",), (" 4",)], "s string")
    assert [r[0] for r in df.select(split_int_list("s")).collect()] == [[1, 5], [1, 5], [4], [4]]


def test_l9_truncating_division_and_exact_mean(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (59, 10)], "a long, b long")
    assert [r[0] for r in df.select(trunc_div("a", "b")).collect()] == [-3, 3, 5]
    m = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(18,2)")
    assert m.agg(mean_exact("x")).first()[0] == Decimal("0.0150")


def test_l9_growth_of_5_9_percent_is_not_above_5(spark):
    # closing balances 100.00 -> 105.90: 5.9 % truncates to 5, which is not > 5
    df = spark.createDataFrame([(1, "2020-01-05", "deposit", Decimal("100.00")),
                                (1, "2020-02-05", "deposit", Decimal("5.90")),
                                (2, "2020-01-05", "deposit", Decimal("100.00")),
                                (2, "2020-02-05", "deposit", Decimal("6.00"))],
                               "customer_id int, d string, txn_type string, txn_amount decimal(18,2)") \
        .withColumn("txn_date", F.to_date("d"))
    out = Wn.balance_growth_share(Wn.signed(df), "customer_id", "txn_date", "signed_amount").first()
    assert (out.n_growing, out.total_customers, out.cust_perc) == (1, 2, 50)


def test_l10_interval_join_equals_comparing_every_pair(spark):
    times = ["2024-01-01 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00", "2024-03-01 12:00:00",
             "1969-12-31 23:00:00", None, "2024-01-01 00:00:00", "9999-12-31 00:00:00"]
    spans = [("day", "2024-01-01 00:00:00", "2024-01-01 23:59:59"), ("week", "2024-01-01 00:00:00", "2024-01-07 23:59:59"),
             ("backwards", "2024-02-01 00:00:00", "2023-02-01 00:00:00"), ("open", "2024-01-08 00:00:00", "9999-12-31 00:00:00"),
             ("years", "1960-05-05 00:00:00", "2024-01-31 00:00:00"), ("none", "2024-01-01 00:00:00", None),
             ("instant", "2024-03-01 12:00:00", "2024-03-01 12:00:00")]
    p = spark.createDataFrame(list(enumerate(times)), "id int, t string").select("id", F.to_timestamp_ntz(F.col("t")).alias("ts"))
    i = spark.createDataFrame(spans, "name string, a string, b string").select(
        "name", F.to_timestamp_ntz(F.col("a")).alias("a"), F.to_timestamp_ntz(F.col("b")).alias("b"))
    got = J.interval_join(p, i, "ts", "a", "b")
    want = set()
    for k, t in enumerate(times):
        inside = {(k, n) for n, a, b in spans if t and b and a <= t <= b}
        want |= inside or {(k, None)}
    assert sorted(((r.id, r.name) for r in got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    none = J.interval_join(p, i.limit(0), "ts", "a", "b")
    assert none.count() == len(times) and none.where("name IS NOT NULL").count() == 0


def test_w39_mean_is_rounded_once(spark):
    from quire.operators import aggs as A
    df = spark.range(10_001).select(F.lit(1).alias("k"), F.lit(1).alias("n"), F.lit(1).alias("d"),
                                    F.when(F.col("id") < 5000, F.lit("0.01")).otherwise("0.00").cast("decimal(10,2)").alias("r"))
    # 50.00 / 10001 = 0.00499..., not 0.01
    assert A.weighted_vs_plain_avg(df, ["k"], "n", "d", "r").first()["incorrect_avg"] == Decimal("0.00")


def test_share_counts_keys_once(spark):
    from quire.operators import aggs as A
    df = spark.createDataFrame([(1, 4), (1, 4), (2, 1), (3, 4), (None, 4)], "k int, s int")
    assert tuple(A.share_of_keys(df, "k", F.col("s") == 4).first()) == (3, 2, Decimal("66.67"))


@pytest.mark.parametrize("form", ["first_after", "last_before", "total_before"])
def test_hot_key_meets_the_starts_by_day(spark, form):
    """A key with a third of all rows brings one row per day to the join with the starts."""
    fact = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500 + 1000).cast("int").alias("customer_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("order_date"),
        F.lit(1).alias("price"))
    starts = fact.select("customer_id").distinct().withColumn("join_date", F.lit("2024-01-20").cast("date"))
    out = getattr(J, form)(fact, starts)
    if form == "total_before":
        assert out.agg(F.sum("n_items")).first()[0] == fact.where("order_date < '2024-01-20'").count()
    else:
        day = "2024-01-20" if form == "first_after" else "2024-01-19"
        hot = out.where("customer_id = 7")
        assert hot.count() == fact.where(f"customer_id = 7 AND order_date = '{day}'").count() and hot.count() > 0
    text = out._jdf.queryExecution().optimizedPlan().toString()
    join = text[text.rindex("Join Inner"):]
    assert "Aggregate [customer_id" in join and "order_date" in join.split("Aggregate [customer_id")[1][:40]


def test_l12_not_in_with_null_key(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    marker = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in J.anti_join_keys(df, marker, ["k"]).collect()] == [2]


def test_l13_downgrade_sees_the_next_state(spark):
    df = spark.createDataFrame([(1, 1, 2, "2020-01-01"), (1, 2, 1, "2020-03-01"), (2, 3, 2, "2020-01-01")],
                               "customer_id int, event_id int, plan_id int, d string") \
        .withColumn("start_date", F.to_date("d"))
    out = Wn.downgrade_count(df, "customer_id", ["start_date", "event_id"], 2, 1, 2020)
    assert out.first()[0] == 1


def test_l15_buckets_keep_empty_ones(spark):
    df = spark.createDataFrame([(5,), (65,), (0,)], "days int")
    got = [tuple(r) for r in Wn.bucket_histogram(df, "days", 30).orderBy("r_from").collect()]
    assert got == [(0, 29, 5.0, 1), (30, 59, None, 0), (60, 89, 65.0, 1)]


def test_l16_schedule_anchored_month_end_and_exclusive_end(spark):
    df = spark.createDataFrame([(1, 1, 0, "2020-01-24", None), (1, 2, 1, "2020-01-31", "9.90"),
                                (1, 3, 2, "2020-04-15", "19.90"), (1, 4, 4, "2020-05-20", None)],
                               "customer_id int, event_id int, plan_id int, d string, p string") \
        .select("customer_id", "event_id", "plan_id", F.to_date("d").alias("start_date"),
                F.col("p").cast("decimal(5,2)").alias("price"))
    out = Wn.expand_schedule(df, "2020-12-31").orderBy("payment_date").collect()
    assert [(r.plan_id, r.payment_date, r.amount, r.payment_order) for r in out] == [
        (1, D("2020-01-31"), Decimal("9.90"), 1), (1, D("2020-02-29"), Decimal("9.90"), 2),
        (1, D("2020-03-31"), Decimal("9.90"), 3), (2, D("2020-04-15"), Decimal("10.00"), 4),
        (2, D("2020-05-15"), Decimal("19.90"), 5)]


def test_l17_running_balance_same_day_rows_share_total(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01", 10), (1, 2, "2020-01-01", 5), (1, 3, "2020-01-02", -3)],
                               "customer_id int, txn_id int, d string, v int").withColumn("txn_date", F.to_date("d"))
    out = Wn.running_balance(df, "customer_id", "txn_date", "v").orderBy("txn_id").collect()
    assert [r.running_balance for r in out] == [15, 15, 12]


def test_l24_two_digit_year_pivot(spark):
    df = spark.createDataFrame([("15/6/98",), ("1/1/20",), ("31/8/49",), ("1/2/50",)], "s string")
    got = [r[0] for r in df.select(cal.parse_short_date("s")).collect()]
    assert got == [D("1998-06-15"), D("2020-01-01"), D("2049-08-31"), D("1950-02-01")]


def test_approximate_opt_ins_are_close(spark):
    from quire.operators import aggs as A
    v = Views(spark, SMALL_SF)
    exact = {r.region_id: r.n_customers for r in
             A.distinct_by(v.v_node_lines, ["region_id"], "customer_id", "n_customers").collect()}
    approx = {r.region_id: r.n_customers for r in
              A.distinct_by(v.v_node_lines, ["region_id"], "customer_id", "n_customers", approx=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)
    closed = (v.v_node.where(F.col("end_date") != F.lit("9999-12-31").cast("date"))
              .withColumn("duration", F.datediff("end_date", "start_date")))
    ex = {r.region_id: r.median for r in A.percentiles_by(closed, ["region_id"], "duration").collect()}
    ap = {r.region_id: r.median for r in A.percentiles_by(closed, ["region_id"], "duration", approx=True).collect()}
    assert all(abs(ap[k] - ex[k]) <= 2 for k in ex)
