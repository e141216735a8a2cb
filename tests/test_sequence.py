"""sequence equals row_number / lag / lead over the key window, skewed or not."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.sequence import sequence
from quire.sources.views import Views

from conftest import SMALL_SF

COLS = ["customer_id", "event_id", "rn", "prev_plan_id", "next_plan_id", "next_start_date"]


def expected(df, keys, order=("start_date", "event_id")):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"rn": F.row_number().over(w).cast("long"), "prev_plan_id": F.lag("plan_id").over(w),
                           "next_plan_id": F.lead("plan_id").over(w),
                           "next_start_date": F.lead("start_date").over(w)})


def got(df, keys, order=("start_date", "event_id"), **kw):
    return sequence(df, keys, list(order), lag_cols=["plan_id"], lead_cols=["plan_id", "start_date"], **kw)


@pytest.fixture(autouse=True)
def cut_small_keys(monkeypatch):
    import importlib
    monkeypatch.setattr(importlib.import_module("quire.operators.sequence"), "MIN_HOT_ROWS", 0)


def same(a, b, cols=COLS):
    a, b = a.select(cols), b.select(cols)
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def subs(spark):
    base = Views(spark, SMALL_SF).v_sub
    # a third of all rows moved onto one hot key
    hot = base.withColumn("customer_id", F.when(F.col("event_id") % 3 == 0, F.lit(7))
                          .otherwise(F.col("customer_id")))
    return base, hot


def test_matches_window_plain_and_hot_key(spark, subs):
    for df in subs:
        assert same(got(df, ["customer_id"]), expected(df, ["customer_id"]))


def test_composite_key_and_pruned_output(spark, subs):
    df = subs[1].withColumn("half", (F.col("event_id") % 2).cast("int"))
    out, exp = got(df, ["customer_id", "half"], keep=["event_id"]), expected(df, ["customer_id", "half"])
    assert set(out.columns) == {"event_id", "customer_id", "half", "plan_id", "start_date", "rn", "prev_plan_id",
                                "next_plan_id", "next_start_date"}
    assert same(out, exp, [*COLS, "half"])


def test_null_keys_null_order_values_and_null_neighbours(spark):
    rows = [(None, 3, None, 1), (None, 1, None, 2), (1, 5, None, None), (1, 2, None, 3), (2, 4, None, 7)]
    df = spark.createDataFrame(rows, "customer_id int, event_id int, start_date date, plan_id int")
    dated = df.unionByName(df.withColumns({"start_date": F.lit("2020-01-01").cast("date"), "event_id": F.col("event_id") + 10}))
    assert same(got(dated, ["customer_id"]), expected(dated, ["customer_id"]))


def test_timestamps_are_cut_into_days(spark, subs):
    df = subs[1].withColumn("start_date", F.to_timestamp("start_date") + F.expr("make_interval(0, 0, 0, 0, event_id % 24)"))
    assert same(got(df, ["customer_id"]), expected(df, ["customer_id"]))
    plan = got(df, ["customer_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan


@pytest.fixture(scope="module")
def long_key(spark):
    """60,000 rows, a third of them on one key, with an order column that is unique inside it."""
    return spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise((F.col("id") * 7919) % 5000).alias("customer_id"),
        ((F.col("id") * 48271) % 60_013).cast("int").alias("event_id"), (F.col("id") % 5).cast("int").alias("plan_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("start_date"))


def test_unique_order_column_of_a_hot_key(spark, long_key):
    for order in (("event_id",), ("start_date", "event_id")):
        assert same(got(long_key, ["customer_id"], order), expected(long_key, ["customer_id"], order))
    # all rows on one key, and no key at all
    one = long_key.withColumn("customer_id", F.lit(1))
    assert same(got(one, ["customer_id"]), expected(one, ["customer_id"]))
    from pyspark.sql import Window
    n = sequence(long_key, [], ["event_id"], lead_cols=["event_id"])
    w = Window.partitionBy(F.lit(1)).orderBy("event_id")
    want = long_key.withColumns({"rn": F.row_number().over(w).cast("long"), "next_event_id": F.lead("event_id").over(w)})
    assert same(n, want, ["event_id", "rn", "next_event_id"])


def test_a_hot_key_is_dealt_evenly(spark, long_key):
    """The tasks that number the rows: the largest reads at most twice the median."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        sizes = sorted(r["n"] for r in got(long_key, ["customer_id"], ("event_id",)).groupBy(F.spark_partition_id().alias("p"))
                       .agg(F.count(F.lit(1)).alias("n"), F.sum("rn"), F.sum("prev_plan_id"), F.count("next_start_date")).collect())
        assert len(sizes) == 32 and sizes[-1] <= 2 * sizes[16], sizes
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fact_exchanges(df, column):
    """Exchanges of the main plan (subqueries left out) whose rows carry ``column``."""
    found = []

    def walk(node, below_subquery=False):
        if node.nodeName().startswith("Exchange") and column in node.schema().toString():
            found.append(node.nodeName())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


def test_the_table_is_shuffled_once(spark, long_key):
    wide = long_key.withColumn("payload", F.col("event_id").cast("string"))
    assert len(fact_exchanges(got(wide, ["customer_id"], ("event_id",)), "payload")) == 1


def test_only_hot_keys_are_cut(spark, long_key):
    from quire.operators.sequence import hot_cuts

    place = F.struct(F.struct(F.col("customer_id").alias("k0")).alias("k"), F.col("event_id").alias("o0"))
    cuts = spark.range(1).select(hot_cuts(long_key, place, 64).alias("c")).first()["c"]
    assert len(cuts) >= 15 and {c["k"]["k0"] for c in cuts} == {-1} and cuts == sorted(cuts, key=lambda c: c["o0"])
    natural = long_key.where("customer_id >= 0")
    assert spark.range(1).select(hot_cuts(natural, place, 64).alias("c")).first()["c"] == []


def test_natural_keys_are_one_window(spark, long_key):
    natural = long_key.where("customer_id >= 0")
    text = got(natural, ["customer_id"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "Subquery" not in text and "_b" not in text
    assert same(got(natural, ["customer_id"]), expected(natural, ["customer_id"]))


def test_small_keys_are_left_whole_without_a_job(spark, subs, monkeypatch):
    import importlib
    module = importlib.import_module("quire.operators.sequence")
    monkeypatch.setattr(module, "MIN_HOT_ROWS", 10**9)
    monkeypatch.setattr(module, "sampled", None)
    assert same(got(subs[1], ["customer_id"]), expected(subs[1], ["customer_id"]))


def test_a_poor_sample_costs_nothing_but_balance(spark, long_key, monkeypatch):
    import importlib

    module = importlib.import_module("quire.operators.ranges")
    want = expected(long_key, ["customer_id"])
    for rows in (0, 3, 40):
        monkeypatch.setattr(module, "sampled", lambda df, n, rows=rows: df.limit(rows))
        monkeypatch.setattr(importlib.import_module("quire.operators.sequence"), "has_hot_key", lambda *a: True)
        assert same(sequence(long_key, ["customer_id"], ["start_date", "event_id"], ["plan_id"], ["plan_id", "start_date"]), want)
