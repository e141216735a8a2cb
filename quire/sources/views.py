"""The fixture views (FIXTURES.md §3) built with the DataFrame API.

Each view re-shapes the driver's TPC-H-like tables into the schema of one
case-study table. Their DuckDB twins live in ``quire.plans.oracle_views``;
both were checked to give equal rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.sequence import sequence
from quire.sources.tables import Tables

OPEN_END = "9999-12-31"

# The case-study dimension tables used by the fixtures.
# campaign (name, first second, last second) — closed intervals, one gap, one overlap
CAMPAIGNS = [
    ("c1", "2024-01-01 00:00:00", "2024-01-07 23:59:59"),
    ("c2", "2024-01-10 00:00:00", "2024-01-16 23:59:59"),
    ("c3", "2024-01-15 00:00:00", "2024-01-25 23:59:59"),
]
# recipe (item name, base member list)
RECIPES = [
    ("STANDARD", "1, 2, 3, 4, 5, 6, 8, 10"),
    ("SMALL", "4, 6, 7, 9, 11, 12"),
    ("LARGE", "1, 3, 5, 7"),
    ("PROMO", "2, 4"),
    ("ECONOMY", "1"),
    ("MEDIUM", "3, 6, 9, 12"),
]
# topping (id, name)
TOPPINGS = [
    (1, "Bacon"), (2, "BBQ Sauce"), (3, "Beef"), (4, "Cheese"), (5, "Chicken"), (6, "Mushrooms"),
    (7, "Onions"), (8, "Pepperoni"), (9, "Peppers"), (10, "Salami"), (11, "Tomatoes"),
    (12, "Tomato Sauce"),
]
# event type codes of the web events: source event name -> code
EVENT_CODES = {"view": 1, "click": 2, "purchase": 3, "signup": 4}  # anything else -> 5


def _s(c) -> F.Column:
    return (c if isinstance(c, F.Column) else F.col(c)).cast("string")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small literal table built JVM-side (a local relation, no Python-RDD scan)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def event_view(events: DataFrame) -> DataFrame:
    """Raw web events -> the case-study event shape (row-local, so it also works on a stream)."""
    et = F.col("event_type")
    code = F.lit(5)
    for name, c in reversed(list(EVENT_CODES.items())):
        code = F.when(et == name, F.lit(c)).otherwise(code)
    return events.select(
        "event_id", "user_id",
        F.concat(_s("user_id"), F.lit("-"), _s(F.col("ts").cast("date"))).alias("visit_id"),
        F.col("ts").alias("event_time"),
        code.alias("event_type"),
        (F.col("event_id") % 13).cast("int").alias("page_id"))


class Views:
    """Lazily built fixture views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # -- case 1 -----------------------------------------------------------
    @cached_property
    def v_sale(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        p = self.t.part.select("p_partkey", "p_type")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(p, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        F.col("l_orderkey").alias("order_id"),
                        F.col("l_linenumber").alias("line_no"),
                        F.col("l_partkey").alias("product_id"),
                        F.col("p_type").alias("product_name"),
                        F.col("l_extendedprice").cast("decimal(18,2)").alias("price")))

    @cached_property
    def v_member(self) -> DataFrame:
        return (self.t.orders.where(F.col("o_orderpriority") == "1-URGENT")
                .groupBy(F.col("o_custkey").alias("customer_id"))
                .agg(F.min("o_orderdate").cast("date").alias("join_date")))

    # -- case 3 -----------------------------------------------------------
    @cached_property
    def v_sub(self) -> DataFrame:
        d = F.substring("o_orderpriority", 1, 1)
        price = (F.when(d == "1", F.lit(0)).when(d == "2", F.lit(9.90))
                 .when(d == "3", F.lit(19.90)).when(d == "4", F.lit(199)))
        return self.t.orders.select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").alias("event_id"),
            (d.cast("int") - 1).alias("plan_id"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            price.cast("decimal(5,2)").alias("price"))

    # -- case 4 -----------------------------------------------------------
    @cached_property
    def v_node_lines(self) -> DataFrame:
        """v_node without end_date (no ordering work), for queries that do not need it."""
        return self._node_base.select("customer_id", "region_id", "node_id", "start_date")

    @cached_property
    def _node_base(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        c = self.t.customer.select("c_custkey", "c_nationkey")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        return (o.join(c, F.col("c_custkey") == F.col("o_custkey"))
                .join(n, F.col("n_nationkey") == F.col("c_nationkey"))
                .select(F.col("o_custkey").alias("customer_id"), F.col("n_regionkey").alias("region_id"),
                        F.col("o_orderpriority").alias("node_id"),
                        F.col("o_orderdate").cast("date").alias("start_date"), "o_orderdate", "o_orderkey"))

    @cached_property
    def v_node(self) -> DataFrame:
        # next start per customer: numbered per (customer, day), not in one per-customer window
        s = sequence(self._node_base, ["customer_id"], ["o_orderdate", "o_orderkey"], lead_cols=["start_date"],
                     rn_name="_rn", keep=["customer_id", "region_id", "node_id", "start_date"])
        return s.select("customer_id", "region_id", "node_id", "start_date",
                        F.coalesce("next_start_date", F.lit(OPEN_END).cast("date")).alias("end_date"))

    @cached_property
    def v_txn(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.t.orders.select(
            F.col("o_orderkey").alias("txn_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("txn_date"),
            F.when(s == "F", "deposit").when(s == "O", "purchase").otherwise("withdrawal").alias("txn_type"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("txn_amount"))

    # -- case 5 -----------------------------------------------------------
    @cached_property
    def v_weekly(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus",
                                    "l_returnflag", "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        c = self.t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        k = F.col("l_linenumber") % 5
        segment = F.when(k == 0, F.lit("null")).otherwise(
            F.concat(F.when(F.col("c_mktsegment") < "C", "C").otherwise("F"), _s(k)))
        return (li.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
                .join(c, F.col("c_custkey") == F.col("o_custkey"))
                .join(n, F.col("n_nationkey") == F.col("c_nationkey"))
                .join(r, F.col("r_regionkey") == F.col("n_regionkey"))
                .groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("week_date"),
                         F.col("r_name").alias("region"), F.col("l_linestatus").alias("platform"),
                         segment.alias("segment"), F.col("l_returnflag").alias("customer_type"))
                .agg(F.count(F.lit(1)).alias("transactions"),
                     F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 0)
                     .cast("bigint").alias("sales")))

    # -- case 6 -----------------------------------------------------------
    @cached_property
    def v_event(self) -> DataFrame:
        return event_view(self.t.events)

    @cached_property
    def v_page(self) -> DataFrame:
        pid = (F.col("event_id") % 13).cast("int")
        return (self.t.events.select(pid.alias("page_id")).distinct()
                .select("page_id",
                        F.concat(F.lit("page_"), _s("page_id")).alias("page_name"),
                        F.when(F.col("page_id").between(3, 11),
                               F.concat(F.lit("cat_"), _s(F.col("page_id") % 3))).alias("product_category"),
                        F.when(F.col("page_id").between(3, 11),
                               (F.col("page_id") - 2).cast("int")).alias("product_id")))

    @cached_property
    def v_campaign(self) -> DataFrame:
        return literal_table(self.spark, CAMPAIGNS, ["campaign_name", "s", "e"]).select(
            "campaign_name",
            F.to_timestamp_ntz(F.col("s")).alias("start_date"),
            F.to_timestamp_ntz(F.col("e")).alias("end_date"))

    # -- case 2 -----------------------------------------------------------
    @cached_property
    def v_recipe(self) -> DataFrame:
        return literal_table(self.spark, RECIPES, ["item_name", "toppings"])

    @cached_property
    def v_topping(self) -> DataFrame:
        return literal_table(self.spark, TOPPINGS, ["topping_id", "topping_name"])

    @cached_property
    def _item_base(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                    "l_extendedprice", "l_tax", "l_discount", "l_returnflag", "l_linestatus")
        p = self.t.part.select("p_partkey", "p_type")
        ln, rf, sk = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_suppkey")
        excl = (F.when(rf == "R", F.concat(_s(ln), F.lit(", "), _s(ln + 2)))
                .when(rf == "A", F.lit("null"))
                .otherwise(F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.lit("4"))))
        extras = (F.when(sk % 4 == 0, _s(1 + sk % 12)).when(sk % 4 == 1, F.lit("null"))
                  .when(sk % 4 == 2, F.lit("")))
        return (li.join(p, F.col("p_partkey") == F.col("l_partkey"))
                .select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
                        F.col("p_type").alias("item_name"), excl.alias("exclusions"), extras.alias("extras"),
                        "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_discount"))

    @cached_property
    def v_item_lines(self) -> DataFrame:
        """v_item without item_no (no ordering work), for queries that do not need the row id."""
        return self._item_base.select("order_id", "part_id", "item_name", "exclusions", "extras")

    @cached_property
    def v_item(self) -> DataFrame:
        # item number inside the order
        s = sequence(self._item_base, ["order_id"], ["l_linenumber", "part_id", "l_suppkey", "l_shipdate",
                                                     "l_extendedprice", "l_tax", "l_discount"], rn_name="_rn",
                     keep=["order_id", "part_id", "item_name", "exclusions", "extras"])
        return s.select("order_id", F.col("_rn").cast("int").alias("item_no"), "part_id",
                        "item_name", "exclusions", "extras")

    @cached_property
    def v_dirty(self) -> DataFrame:
        k = F.col("o_orderkey")
        void = k % 11 == 0
        pickup = F.when(void, F.lit("null")).otherwise(
            F.concat(_s(F.col("o_orderdate").cast("date")), F.lit(" 00:"), _s(10 + k % 50), F.lit(":34")))
        dist = (F.when(void, F.lit("null"))
                .when(k % 3 == 0, F.concat(_s(5 + k % 20), F.lit(".4 km")))
                .when(k % 3 == 1, F.concat(_s(5 + k % 20), F.lit("km")))
                .otherwise(_s(5 + k % 20)))
        dur = (F.when(void, F.lit("null"))
               .when(k % 4 == 0, F.concat(_s(10 + k % 110), F.lit(" minutes")))
               .when(k % 4 == 1, F.concat(_s(10 + k % 110), F.lit("mins")))
               .otherwise(_s(10 + k % 110)))
        canc = (F.when(void, F.lit("Customer Cancellation")).when(k % 3 == 0, F.lit(""))
                .when(k % 3 == 1, F.lit("null")))
        return self.t.orders.select(
            k.alias("order_id"), (F.col("o_custkey") % 10).alias("runner_id"),
            F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_time"),
            pickup.alias("pickup_time"), dist.alias("distance"), dur.alias("duration"),
            canc.alias("cancellation"))

    @cached_property
    def v_rating(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.t.orders.select(
            F.when(k % 97 == 1, k - 1).otherwise(k).alias("order_id"),
            (F.col("o_custkey") % 10).alias("runner_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(k % 101 == 0, F.lit(78)).otherwise((1 + k % 5).cast("int")).cast("int").alias("rating"))
