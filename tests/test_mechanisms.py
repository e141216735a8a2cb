"""Rank selection, bitmaps, co-partitioned tables, balances by delta, sweep lines, prefix sums, gaps, interval slots."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import aggs, balances, funnel, joins, windows
from quire.operators.ranges import estimated_rows, sampled, search, split_points
from quire.plans.cleaning import co_partitioned_orders, order_totals
from quire.session import checkpoint_dir
from quire.sources.sinks import materialize
from quire.sources.views import Views

from conftest import SMALL_SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- ranges ---------------------------------------------------------------
def test_search_counts_the_split_points_at_or_below(spark):
    df = spark.createDataFrame([(x,) for x in (-5, 0, 1, 3, 4, 9, 10, 11, None)], "x int")
    for splits in ([], [4], [0, 3, 10], [1, 2, 3, 4, 5, 6, 7]):
        got = search(df, F.array(*[F.lit(s) for s in splits]).cast("array<int>"), F.col("x"), 8, "b").select("x", "b").collect()
        assert {r.x: r.b for r in got} == {x: sum(s <= x for s in splits) if x is not None else 0 for x in (-5, 0, 1, 3, 4, 9, 10, 11, None)}


def test_split_points_cut_evenly(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id")).alias("x"))
    cut = search(df, split_points(df, F.col("x"), 16), F.col("x"), 16, "b").groupBy("b").count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 2 * 20_000 / 16
    assert spark.range(1).select(split_points(df.where("x < 0"), F.col("x"), 16).alias("s")).first()["s"] == []


def test_samples_are_bounded(spark):
    files = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    n = files.count()
    assert n / 8 < estimated_rows(files) < 8 * n
    assert sampled(files, 500).count() < n / 2
    # a small table that explodes: the estimate is far too low, the sample still bounded
    exploded = spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("x"))
    assert sampled(exploded, 20).count() <= 64 * 20


# -- rank selection (W31) -------------------------------------------------
def test_percentiles_by_rank(spark):
    data = [("hot", float(i * 37 % 10_007)) for i in range(5000)] + [("same", 2.5)] * 3000 + [("two", 1.0), ("two", 4.0), ("one", 7.0)]
    data += [(None, float(i)) for i in range(9)] + [("none", None), ("hot", None), (None, None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    want = aggs.percentiles_by(df, ["g"], "v")
    assert rows(aggs.percentiles_by_rank(df, ["g"], "v")) == rows(want)
    ends = aggs.percentiles_by_rank(df, ["g"], "v", (0.0, 1.0), ("lo", "hi"))
    assert rows(ends) == rows(df.groupBy("g").agg(F.min("v"), F.max("v")))
    assert aggs.percentiles_by_rank(df.limit(0), ["g"], "v").count() == 0
    assert rows(aggs.percentiles_by_rank(df, [], "v")) == rows(aggs.percentiles_by(df, [], "v"))


def test_no_group_is_gathered(spark):
    """No value map, and every window is over a (group, range) or over counts per range."""
    from test_plans import windows_below
    df = aggs.percentiles_by_rank(spark.read.parquet(f"{SMALL_SF}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice")
    assert "percentile(" not in plan(df)
    seen = list(windows_below(df))
    assert {tuple(k) for k, _ in seen} == {("_k",), ("_k", "_b")}
    assert all("HashAggregate" in "".join(below) for _, below in seen)


# -- bitmaps (W32) ----------------------------------------------------------
def test_distinct_rollup_reads_the_bitmaps_only(spark):
    ev = Views(spark, SMALL_SF).v_event
    stored = materialize(aggs.daily_bitmaps(ev, F.col("event_time").cast("date"), "user_id"), "days", partition_by=["day"])
    text = plan(aggs.distinct_rollup(stored))
    assert "events.parquet" not in text and "count(distinct" not in text and text.count("FileScan") == 1


def test_distinct_rollup_edges(spark):
    data = [("2024-01-31", 1), ("2024-01-31", 1), ("2024-02-01", 1), ("2024-02-01", 40_000_000_000), ("2024-02-02", -3), ("2024-02-02", None), (None, 8)]
    df = spark.createDataFrame(data, "d string, u long").select(F.col("d").cast("date"), "u")
    got = {(r.level, str(r.start)): r.n_distinct for r in aggs.distinct_rollup(aggs.daily_bitmaps(df, F.col("d"), "u")).collect()}
    assert got == {("day", "2024-01-31"): 1, ("day", "2024-02-01"): 2, ("day", "2024-02-02"): 1, ("month", "2024-01-01"): 1,
                   ("month", "2024-02-01"): 3, ("all", "None"): 3}


# -- co-partitioned tables (W10) ----------------------------------------------
def test_co_partitioned_tables_join_without_exchange(spark):
    v = Views(spark, SMALL_SF)
    orders, lines = co_partitioned_orders(v, buckets=4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = order_totals(orders, lines)
        df.collect()
        text = plan(df)
        assert "Exchange" not in text.split("== Initial Plan ==")[0] and "SortMergeJoin" in text
        plain = order_totals(v.t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")),
                             v.t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price")))
        assert rows(df) == rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert checkpoint_dir(spark).split(":")[-1] in spark.sql("DESCRIBE EXTENDED quire_orders_by_id").where("col_name = 'Location'").first()[1]


# -- balances by delta (W51) ---------------------------------------------------
def ledger(spark, data):
    return spark.createDataFrame(data, "customer_id long, d string, v decimal(18,2)").select("customer_id", F.col("d").cast("date"), "v")


def test_late_batches_equal_one_load(spark, tmp_path):
    from decimal import Decimal as D
    path = f"file://{tmp_path}/store"
    first = [(1, "2024-03-05", D(10)), (1, "2024-06-01", D(5)), (2, "2024-01-01", D(-4)), (None, "2024-02-02", D(3))]
    batches = [[(1, "2024-01-09", D(2)), (1, "2024-04-30", D(-7)), (1, "2024-04-01", D(1))], [(3, "2023-12-31", D("0.5")), (None, "2024-02-03", D(1))],
               [(2, "2025-01-01", D(9)), (1, "2024-06-30", D(1))], []]
    balances.store_balances(ledger(spark, first), path, "customer_id", "d", "v", buckets=8)
    seen = list(first)
    for batch in batches:
        balances.merge_late(spark, path, ledger(spark, batch), "customer_id", "d", "v", buckets=8)
        seen += batch
        assert rows(balances.read_balances(spark, path).select("customer_id", "month", "monthly_balance", "closing_balance")) == \
            rows(windows.period_balance(ledger(spark, seen), "customer_id", "d", "v"))


def test_untouched_keys_are_neither_read_nor_written(spark, tmp_path):
    from decimal import Decimal as D
    path = f"{tmp_path}/store"
    balances.store_balances(ledger(spark, [(i, f"2024-0{1 + i % 6}-01", D(i)) for i in range(200)]), f"file://{path}", "customer_id", "d", "v", buckets=16)
    files = {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.startswith("part-")}
    late = ledger(spark, [(7, "2024-01-15", D(1))])
    merged, touched = balances.merged_balances(spark.read.parquet(f"file://{path}"), late, "customer_id", "d", "v", buckets=16)
    assert len(touched) == 1 and re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {touched[0]}\)", plan(merged))
    assert balances.merge_late(spark, f"file://{path}", late, "customer_id", "d", "v", buckets=16) == touched
    after = {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.startswith("part-")}
    gone = set(files) - set(after)
    assert gone and all(f"/bucket={touched[0]}/" in f for f in gone | (set(after) - set(files)))
    assert all(after[f] == t for f, t in files.items() if f not in gone)


# -- sweep line (W46), prefix sums (W52), gaps (W29) ---------------------------
def test_state_mix_equals_the_asof_query(spark):
    subs = Views(spark, SMALL_SF).v_sub
    mix = windows.state_mix(subs, "customer_id", ["start_date", "event_id"])
    ends = [r[0] for r in mix.select("month_end").distinct().orderBy("month_end").collect()]
    for e in (ends[0], ends[len(ends) // 2], ends[-1]):
        assert rows(mix.where(F.col("month_end") == F.lit(e)).drop("month_end")) == \
            rows(windows.state_asof_latest(subs, "customer_id", str(e), ["start_date", "event_id"]))


def test_cube_equals_single_anchors(spark):
    from quire.plans.common import weekly
    w = weekly(Views(spark, SMALL_SF))
    dims = ["region", "platform"]
    any_week = windows.cube_before_after(windows.prefix_cube(w, "week_date", dims), 4).where("week = date'1997-03-02'").drop("week")
    one = windows.before_after_by_dimension(w, "week_date", "1997-03-03", 4, dims)
    assert rows(any_week) == rows(one)


def test_missing_runs(spark):
    df = spark.createDataFrame([(x,) for x in (5, 5, 6, 9, -2, None, 10**12)], "x long")
    assert rows(windows.missing_runs(df, "x")) == [(-1, 4, 6), (10, 10**12 - 1, 10**12 - 10), (7, 8, 2)]
    assert windows.missing_runs(df.where("x = 5"), "x").count() == 0 and windows.missing_runs(df.limit(0), "x").count() == 0


# -- interval slots (W22) ---------------------------------------------------
def brute_intervals(points, intervals):
    out = []
    for p, t in points:
        hits = [n for n, a, b in intervals if t is not None and a is not None and b is not None and a <= t <= b]
        out += [(p, n) for n in hits] or [(p, None)]
    return sorted(out, key=str)


def test_interval_join_edges(spark):
    intervals = [("a", 0, 10), ("b", 5, 5), ("c", 5, 4), ("d", None, 9), ("e", 9, None), ("f", -10**9, 10**9), ("g", 10, 20), ("a2", 0, 10)]
    points = [(1, 0), (2, 5), (3, 10), (4, 11), (5, 2 * 10**9), (6, None), (7, -5), (7, -5)]
    i = spark.createDataFrame(intervals, "n string, a long, b long")
    p = spark.createDataFrame(points, "p int, t long")
    assert sorted(map(tuple, joins.interval_join(p, i, "t", "a", "b").select("p", "n").collect()), key=str) == brute_intervals(points, intervals)
    assert rows(joins.interval_join(p, i.limit(0), "t", "a", "b").select("p", "n")) == sorted([(x, None) for x, _ in points], key=str)


def test_a_million_overlapping_intervals_and_a_hot_hour(spark):
    """Interval k is [10 k, 10 k + 95]; a third of the points lie in one hour."""
    n = 1_000_000
    intervals = spark.range(0, n, 1, 8).select((F.col("id") * 10).alias("a"), (F.col("id") * 10 + 95).alias("b"))
    points = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 5_000_000 + F.col("id") % 3600).otherwise(
        (F.col("id") * 7_919_333) % 10_100_000).alias("t"))
    got = joins.interval_join(points, intervals, "t", "a", "b").agg(F.count("a").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    last = F.least(F.floor(F.col("t") / 10), F.lit(n - 1))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - 95) / 10))
    want = points.agg(F.sum(F.greatest(F.lit(0), last - first + 1)).alias("hits"), F.sum(F.greatest(F.lit(1), last - first + 1)).alias("n")).first()
    assert tuple(got) == tuple(want) and got["hits"] > 400_000


def test_points_are_shuffled_at_most_once(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, SMALL_SF)
        from test_sequence import fact_exchanges
        assert len(fact_exchanges(joins.interval_join(v.v_event, v.v_campaign, "event_time", "start_date", "end_date"), "event_time")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


# -- composed maps (W45), three-phase top-k (W58) -----------------------------
def walked(histories, steps):
    n = 0
    for h in histories.values():
        at = 0
        for s in h:
            if at < len(steps):
                wanted, never = steps[at]
                at = at + 1 if s == wanted else 0 if s in never else at
        n += at == len(steps)
    return n


@pytest.mark.parametrize("hot", [False, True])
def test_path_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "has_hot_key", lambda *a: hot)
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.col("id") % 211).alias("customer_id"),
                                  F.col("id").alias("event_id"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("int").alias("plan_id"))
    df = df.withColumn("plan_id", F.when(F.col("plan_id") == 6, None).otherwise(F.col("plan_id"))).repartition(5)
    histories = {}
    for r in sorted(df.collect(), key=lambda r: r.event_id):
        if r.customer_id is not None:
            histories.setdefault(r.customer_id, []).append(r.plan_id)
    paths = {"x": [(0, []), (1, [2]), (3, [4, 5])], "y": [(5, [])], "z": [(0, []), (1, [2, 3, 4, 5]), (0, [1, 2, 3, 4, 5]), (1, [2, 3, 4, 5])], "never": [(99, [])]}
    got = {r.path: r.n_customers for r in windows.path_counts(df, "customer_id", ["event_id"], paths).collect()}
    assert got == {n: walked(histories, p) for n, p in paths.items()} and got["y"] > 0


def test_top_k_by_sketch(spark, monkeypatch):
    counts = {i: 1 + i % 4 for i in range(300)} | {1000 + i: 50 + i // 2 for i in range(12)}
    rows_of = [(v,) for v, n in counts.items() for _ in range(n)] + [(None,)] * 500
    df = spark.createDataFrame(rows_of, "v int").repartition(4)
    for cells in (16_384, 64, 1):
        monkeypatch.setattr(funnel, "SKETCH_CELLS", cells)
        for k in (1, 2, 5, 12, 13, 400):
            kth = sorted(counts.values(), reverse=True)[min(k, len(counts)) - 1]
            got = {r.v: r.n for r in funnel.top_k_by_sketch(df, "v", k).collect()}
            assert got == {v: n for v, n in counts.items() if n >= kth}, (cells, k)
    assert funnel.top_k_by_sketch(df.where("v IS NULL"), "v", 3).count() == 0


def test_only_candidates_are_counted(spark):
    """Uneven counts: far fewer values pass the last bound than there are."""
    uneven = spark.range(100_000).select(F.floor(50_000 * F.pow(F.rand(5), 6)).alias("v"))
    left = funnel.top_k_candidates(uneven, "v", 10).distinct().count()
    assert 10 <= left < uneven.distinct().count() / 100
