"""Hand-worked answers on small tables of a hire shop and a sandwich bar."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.operators import aggs as A
from quire.operators import cleaning as C
from quire.operators import funnel as Fn
from quire.operators import joins as J
from quire.operators import lists as L
from quire.operators import windows as Wn

D = dt.date.fromisoformat

SALES = [("X", "2023-03-01", 1), ("X", "2023-03-03", 2), ("X", "2023-03-03", 3), ("X", "2023-03-08", 3),
         ("Y", "2023-03-02", 2), ("Y", "2023-03-05", 2), ("Y", "2023-03-09", 1), ("Z", "2023-03-04", 3)]
GOODS = [(1, "hammer", 4), (2, "ladder", 9), (3, "saw", 7)]
MEMBERS = [("X", "2023-03-03"), ("Y", "2023-03-06")]

ORDERS = [(1, 11, 1, "", None), (2, 11, 2, "4", "null"), (2, 11, 1, "null", "1, 4"), (3, 12, 1, "2, 3", "3"),
          (4, 13, 2, None, "2")]
TRIPS = [(1, 1, "2022-05-01 12:10:00", "7.5km", "21 minutes", ""),
         (2, 1, "2022-05-01 13:00:00", "4 km", "12mins", "null"),
         (3, 2, "null", "null", "null", "Shop closed"),
         (4, 2, "2022-05-02 09:30:00", "10", "33", None)]
NAMES = [(1, "Big"), (2, "Tiny")]
FILLINGS = [(1, "1, 2, 3"), (2, "2, 4")]
TOPPINGS = [(1, "Beet"), (2, "Cress"), (3, "Dill"), (4, "Egg")]


@pytest.fixture(scope="module")
def sales_case(spark):
    sales = spark.createDataFrame(SALES, "customer_id string, d string, product_id int") \
        .select("customer_id", F.to_date("d").alias("order_date"), "product_id")
    goods = spark.createDataFrame(GOODS, "product_id int, product_name string, price int")
    members = spark.createDataFrame(MEMBERS, "customer_id string, d string") \
        .select("customer_id", F.to_date("d").alias("join_date"))
    return sales.join(goods, "product_id"), members


@pytest.fixture(scope="module")
def orders_case(spark):
    orders = spark.createDataFrame(ORDERS, "order_id int, customer_id int, kind_id int, exclusions string, extras string")
    orders = C.add_row_id(orders, ["order_id"], ["kind_id", "exclusions", "extras"], "item_no")
    trips = spark.createDataFrame(TRIPS, "order_id int, runner_id int, pickup_time string, distance string, "
                                         "duration string, cancellation string")
    names = spark.createDataFrame(NAMES, "kind_id int, kind_name string")
    fillings = spark.createDataFrame(FILLINGS, "kind_id int, toppings string")
    toppings = spark.createDataFrame(TOPPINGS, "topping_id int, topping_name string")
    return orders, C.clean_deliveries(trips), names, fillings, toppings


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_total_per_customer(sales_case):
    sales, _ = sales_case
    assert rows(J.enrich_total(sales, ["customer_id"], "price"), "customer_id", "total_amount") == [("X", 27), ("Y", 22), ("Z", 7)]


def test_visit_days(sales_case):
    sales, _ = sales_case
    assert rows(A.distinct_by(sales, ["customer_id"], "order_date", "days"), "customer_id", "days") == [("X", 3), ("Y", 3), ("Z", 1)]


def test_most_bought_ties_by_name(sales_case):
    sales, _ = sales_case  # three ladders, three saws
    assert rows(Fn.top_k(sales, ["product_name"], k=1), "product_name", "n") == [("ladder", 3)]


def test_favourites(sales_case):
    sales, _ = sales_case
    out = Wn.top_by_count_per_key(sales.where("order_date < '2023-03-08'"), "customer_id", "product_name")
    assert rows(out, "customer_id", "product_name", "n") == [
        ("X", "hammer", 1), ("X", "ladder", 1), ("X", "saw", 1), ("Y", "ladder", 2), ("Z", "saw", 1)]


def test_first_after_and_last_before(sales_case):
    sales, members = sales_case
    assert rows(J.first_after(sales, members), "customer_id", "product_name") == [("X", "ladder"), ("X", "saw"), ("Y", "hammer")]
    assert rows(J.last_before(sales, members), "customer_id", "product_name") == [("X", "hammer"), ("Y", "ladder")]


def test_total_before(sales_case):
    sales, members = sales_case
    assert rows(J.total_before(sales, members), "customer_id", "n_items", "total_amount") == [("X", 1, 4), ("Y", 2, 18)]


def test_points(sales_case):
    sales, members = sales_case
    out = Fn.item_points(sales, "customer_id", "price", "product_name", "hammer")
    assert rows(out, "customer_id", "points") == [("X", 310), ("Y", 260), ("Z", 70)]
    out = Fn.join_week_points(sales, members, "customer_id", "price", "product_name", "hammer", "2023-03-08")
    assert rows(out, "customer_id", "points") == [("X", 540), ("Y", 180)]


def test_member_flag_ranking(sales_case):
    sales, members = sales_case
    out = J.rank_flagged(sales, members, ["order_date", "product_id"])
    assert rows(out.where("customer_id = 'X'"), "order_date", "product_id", "member", "ranking") == [
        (D("2023-03-01"), 1, "N", None), (D("2023-03-03"), 2, "Y", 1), (D("2023-03-03"), 3, "Y", 2), (D("2023-03-08"), 3, "Y", 3)]
    assert rows(out.where("customer_id = 'Z'"), "member", "ranking") == [("N", None)]


def test_order_counts(orders_case):
    orders, *_ = orders_case
    assert orders.count() == 5
    assert A.distinct_pairs(orders, ["order_id", "customer_id"]).count() == 4


def test_cleaning(orders_case):
    _, trips, *_ = orders_case
    got = dict((r.order_id, (r.distance, r.duration)) for r in trips.collect())
    assert got == {1: (Decimal("7.50"), 21), 2: (Decimal("4.00"), 12), 3: (None, None), 4: (Decimal("10.00"), 33)}
    assert rows(trips.where("cancellation IS NULL"), "order_id") == [(1,), (2,), (4,)]


def test_success_rate(orders_case):
    _, trips, *_ = orders_case
    out = A.success_rate(trips, "runner_id", "order_id", "cancellation")
    assert rows(out, "runner_id", "success_pct") == [(1, Decimal("100.00")), (2, Decimal("50.00"))]


def _delivered(orders, trips):
    return orders.join(trips.where("cancellation IS NULL").select("order_id", "distance"), "order_id")


def price():
    return F.when(F.col("kind_id") == 1, 12).otherwise(10)


def test_revenue_and_surcharge(orders_case):
    orders, trips, *_ = orders_case
    d = _delivered(orders, trips)
    assert A.group_revenue(d, "kind_id", price()).agg(F.sum("revenue")).first()[0] == 44
    assert L.list_surcharge(d, price(), "extras").first()[0] == 47


def test_profit_after_mileage(orders_case):
    orders, trips, *_ = orders_case
    # 12 - 2.25, 22 - 1.20, 10 - 3.00
    assert A.profit_after_cost(_delivered(orders, trips), "order_id", price(), "distance").first()[0] == Decimal("37.55")


DESCRIBED = ["Big", "Big - Exclude Cress, Dill - Extra Dill", "Big - Extra Beet, Egg", "Tiny - Exclude Egg", "Tiny - Extra Cress"]
EDITED = ["Big: 2x Beet, Cress, Dill, Egg", "Big: Beet, Cress, Dill", "Big: Beet, Dill", "Tiny: 2x Cress, Egg", "Tiny: Cress"]


@pytest.mark.parametrize("wide", [False, True])
def test_item_texts_by_map_and_by_join(spark, orders_case, wide):
    """A name table past the measured bound (here 5 million rows, which a generator's plan
    statistics put at a few bytes) is joined, not looked up, with the same result."""
    orders, _, names, fillings, toppings = orders_case
    if wide:
        more = spark.range(1).select(F.explode(F.sequence(F.lit(5), F.lit(5_000_004))).alias("topping_id"), F.lit("other").alias("topping_name"))
        toppings = toppings.unionByName(more)
    items = orders.join(names, "kind_id").withColumnRenamed("kind_name", "item_name")
    base = fillings.join(names, "kind_id").withColumnRenamed("kind_name", "item_name")
    keys = ["order_id", "item_no"]
    out = L.describe_item(items, keys, "item_name", "exclusions", "extras", toppings)
    assert sorted(r.order_item for r in out.collect()) == DESCRIBED
    out = L.apply_list_edits(items, keys, "item_name", base, "toppings", "exclusions", "extras", toppings)
    assert sorted(r.ingredients for r in out.collect()) == EDITED
    out = L.list_text(fillings, ["kind_id"], "toppings", toppings)
    assert rows(out, "kind_id", "members") == [(1, "Beet, Cress, Dill"), (2, "Cress, Egg")]


def test_top_extra_and_exclusion_ties_by_name(orders_case):
    orders, *_, toppings = orders_case
    assert rows(L.top_list_member(orders, "extras", toppings), "topping_name", "n") == [("Beet", 1)]
    assert rows(L.top_list_member(orders, "exclusions", toppings), "topping_name", "n") == [("Cress", 1)]


def test_member_totals_are_ordered(orders_case):
    orders, _, names, fillings, toppings = orders_case
    items = orders.join(names, "kind_id").withColumnRenamed("kind_name", "item_name")
    base = fillings.join(names, "kind_id").withColumnRenamed("kind_name", "item_name")
    out = L.member_totals(items, ["order_id"], "item_name", base, "toppings", "exclusions", "extras", toppings)
    assert [(r.topping_name, r.n_used) for r in out.collect()] == [("Cress", 5), ("Beet", 4), ("Dill", 3), ("Egg", 2)]


def test_list_separator_and_type(spark):
    df = spark.createDataFrame([(1, "a|b", "x|y|z"), (2, "null", None)], "id int, p string, q string")
    assert rows(L.explode_list(df, "p", ["id"], id_name="m", sep=r"\|", member_type="string"), "id", "m") == [(1, "a"), (1, "b")]
    out = L.zip_lists(df, "p", "q", ["id"], sep=r"\|", member_type="string")
    assert rows(out, "exclusion", "extra") == [("a", "x"), ("b", "y"), (None, "z")]
    assert L.list_surcharge(df, F.lit(1), "q", sep=r"\|").first()[0] == 5
