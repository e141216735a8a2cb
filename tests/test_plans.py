"""Plan properties that matter at scale."""

import importlib
import re

import pytest

from quire.plans.registry import queries

from conftest import SMALL_SF

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_a_plan(spark, name):
    assert not re.search(r"EvalPython|InPandas|InArrow|MapInPandas|MapInArrow|Scan ExistingRDD",
                         plan(QUERIES[name](spark, SMALL_SF)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_and_no_forced_broadcast(spark, name):
    df = QUERIES[name](spark, SMALL_SF)
    assert "strategy=broadcast" not in df._jdf.queryExecution().logical().toString()
    nested = re.findall(r"(?:BroadcastNestedLoopJoin|CartesianProduct).*", plan(df))
    # a key that pairs one-row aggregates only
    assert not nested or name == "viewed_without_buying", nested


ENTITY_KEYS = (["customer_id"], ["order_id"], ["o_custkey"], ["l_orderkey"])


def windows_below(df):
    """(partition columns, does it rank with an upper bound, are its rows aggregated per more than
    the partition columns below it) of every window of the executed plan."""
    lines = plan(df).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    for i, line in enumerate(lines):
        m = re.match(r"[ :+|-]*(?:\*\(\d+\) )?Window \[.*?\], \[([^\]]*)\]", line)
        if not m:
            continue
        below = []
        for j in range(i + 1, len(lines)):
            if depth[j] <= depth[i]:
                break
            below.append(lines[j])
            if re.search(r"Join|Scan", lines[j]):
                break  # the rows that reach the window come from here
        yield [a.split("#")[0].strip() for a in m.group(1).split(",") if a.strip()], below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_window_over_a_bare_entity_key(spark, name, monkeypatch):
    """A window over a customer or order key alone puts a hot key's rows into one task. Where there is
    such a key it may stand only on a group limit (few rows per key and task) or directly on an
    aggregation."""
    monkeypatch.setattr(importlib.import_module("quire.operators.sequence"), "has_hot_key", lambda *a: True)
    for keys, below in windows_below(QUERIES[name](spark, SMALL_SF)):
        if keys in ENTITY_KEYS:
            text = "\n".join(below)
            assert "WindowGroupLimit" in text or "HashAggregate" in text, (name, keys, text)


def test_the_window_test_can_fail(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{SMALL_SF}/orders.parquet").select(F.col("o_custkey").alias("customer_id"), "o_orderdate")
    bad = df.withColumn("n", F.lead("o_orderdate").over(Window.partitionBy("customer_id").orderBy("o_orderdate")))
    (keys, below), = windows_below(bad)
    assert keys == ["customer_id"] and not any("HashAggregate" in x or "WindowGroupLimit" in x for x in below)


@pytest.mark.parametrize("name", ["first_per_key", "state_asof_latest", "item_funnel", "visit_summary",
                                  "viewed_without_buying", "days_between_states", "funnel_leaders"])
def test_aggregate_not_window(spark, name):
    """Operators that pick per-key rows by aggregation plan no window over a key (a total over
    already aggregated rows has no key)."""
    assert not any(keys for keys, _ in windows_below(QUERIES[name](spark, SMALL_SF)))


def test_scan_prunes_columns(spark):
    txt = plan(QUERIES["enrich_total"](spark, SMALL_SF))
    lineitem_schema = re.search(r"lineitem.parquet.*?ReadSchema: (struct<[^>]*>)", txt, re.S)
    assert lineitem_schema and "l_shipdate" not in lineitem_schema.group(1)


def test_running_balance_windows_per_day_aggregate(spark):
    txt = plan(QUERIES["running_balance"](spark, SMALL_SF))
    # the Window sits above a HashAggregate (one row per key-day), not above the raw scan
    after_window = txt[txt.index("Window"):]
    assert "HashAggregate" in after_window


@pytest.mark.parametrize("name", ["enrich_total", "totals_by", "distinct_by", "conditional_counts",
                                  "first_per_key", "state_asof_latest", "item_funnel", "visit_summary",
                                  "viewed_without_buying", "before_after_by_dimension", "qualifying_groups",
                                  "member_totals", "percentiles_by"])
def test_map_side_partial_aggregation(spark, name):
    """Aggregates run partial before their shuffle, so a hot key sends one row per task."""
    txt = plan(QUERIES[name](spark, SMALL_SF))
    assert re.search(r"functions=\[[^\]]*partial_", txt), txt


def test_per_dimension_before_after_is_one_grouping_sets_pass(spark):
    txt = plan(QUERIES["before_after_by_dimension"](spark, SMALL_SF))
    assert txt.count("Expand [") == 1
