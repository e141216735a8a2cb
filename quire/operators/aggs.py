"""Aggregation operators.

Every operator here is a hash aggregation that Spark runs in two phases
(partial per map task, final after the shuffle), so the shuffle carries at
most one row per key per task — a hot key costs no more than a cold one.
Grouped results are small, so windows over them (shares, ranks) are cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numeric import mean4, mean_exact, percent, trunc_div
from quire.operators.ranges import search, split_points, value_ranges


def totals_by(df: DataFrame, keys: list[str], measure: str, prefix: str = "amount",
              count_name: str = "n_rows", money_scale: int | None = None) -> DataFrame:
    """count, sum, mean, min and max of ``measure`` per key; no keys = one global row.

    With ``money_scale`` (the measure is DECIMAL(_, money_scale)) the mean is
    exact, DECIMAL(38, 4) rounded half away from zero, instead of a double.
    """
    mean = mean_exact(measure, money_scale) if money_scale is not None else mean4(measure)
    aggs = [F.count(F.lit(1)).alias(count_name),
            F.sum(measure).cast("decimal(38,2)").alias(f"total_{prefix}"),
            mean.alias(f"avg_{prefix}"),
            F.min(measure).alias(f"min_{prefix}"),
            F.max(measure).alias(f"max_{prefix}")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def percentiles_by(df: DataFrame, keys: list[str], col: str, ps=(0.5, 0.8, 0.95),
                   names=("median", "p80", "p95"), approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Exact, linearly interpolated percentiles per group (PERCENTILE_CONT).

    Spark's exact ``percentile`` keeps a value->count map per group and
    merges maps across tasks, so memory grows with the number of distinct
    values (days here), not with rows. ``approx=True`` switches to
    ``percentile_approx`` (a fixed-size sketch per group, relative rank error
    about 1/accuracy) for continuous measures with unbounded distinct values.
    """
    if approx:
        return df.groupBy(*keys).agg(*[F.percentile_approx(col, p, accuracy).cast("double").alias(n)
                                       for p, n in zip(ps, names)])
    # all percentiles from one value map
    out = df.groupBy(*keys).agg(F.percentile(col, [float(p) for p in ps]).alias("_p"))
    return out.select(*keys, *[F.round(F.get("_p", F.lit(i)), 4).alias(n) for i, n in enumerate(names)])


def percentiles_by_rank(df: DataFrame, keys: list[str], col: str, ps=(0.5, 0.8, 0.95),
                        names=("median", "p80", "p95")) -> DataFrame:
    """``percentiles_by`` for measures with any number of distinct values (W31): the same exact,
    interpolated percentiles by rank selection, without a value map or a sort of any group.

    The values are cut into ranges (split points of a sample, so the result does not depend on
    them). Counts per (group, range), summed over the ranges before, tell in which range each wanted
    rank lies; only rows of those ranges are read again, counted per value, and ranked inside
    their (group, range). A group's rows never meet: a range holds one part in
    ``value_ranges`` of all rows, and a value that many rows share is one counted row. Nulls do not
    count; groups without a value have null percentiles.
    """
    ranges = value_ranges(df)
    rows = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("z")).alias("_k"), F.col(col).alias("_v"))
    present = rows.where("_v IS NOT NULL")
    cut = search(present, split_points(present, F.col("_v"), ranges), F.col("_v"), ranges, "_b").drop("_splits")
    counts = cut.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_k")
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the two ranks around each percentile, from 0; both are the same where it falls on a row
    at = F.array(*[F.struct(F.lit(i).alias("p"), ((F.col("_n") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(ps)])
    ranks = counts.withColumns({"_before": before, "_n": F.sum("_c").over(w)}).select("_k", "_b", "_c", "_before", F.explode(at).alias("_x"))
    ranks = ranks.select("_k", "_b", "_c", "_before", "_x.p", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor("_x.h").alias("rank"), (F.col("_x.h") - F.floor("_x.h")).alias("part")),
        F.struct(F.lit(1).alias("side"), F.ceil("_x.h").alias("rank"), (F.col("_x.h") - F.floor("_x.h")).alias("part")))).alias("_r"))
    wanted = (ranks.where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_c")))
              .select("_k", "_b", "p", "_r.side", "_r.part", (F.col("_r.rank") - F.col("_before")).alias("_at")))
    held = cut.join(wanted.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi").groupBy("_k", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_v"))
    placed = held.withColumn("_upto", upto).join(wanted, ["_k", "_b"]).where(
        (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
    value = F.col("_v").cast("double")
    ends = placed.groupBy("_k", "p").agg(F.max(F.when(F.col("side") == 0, value)).alias("_lo"), F.max(F.when(F.col("side") == 1, value)).alias("_hi"),
                                         F.max("part").alias("_part"))
    found = ends.groupBy("_k").agg(*[F.max(F.when(F.col("p") == i, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))).alias(n)
                                     for i, n in enumerate(names)])
    groups = rows.select("_k").distinct().withColumnRenamed("_k", "_g")
    return groups.join(found, F.col("_g") == F.col("_k"), "left").select(
        *[F.col(f"_g.k{i}").alias(k) for i, k in enumerate(keys)], *[F.round(n, 4).alias(n) for n in names])


def distinct_by(df: DataFrame, keys: list[str], col: str, name: str, approx: bool = False,
                rsd: float = 0.01) -> DataFrame:
    """Distinct count of ``col`` per key (W32); ``approx=True`` uses a HyperLogLog++
    sketch (``approx_count_distinct``, relative standard deviation ``rsd``) whose
    partial aggregates have a fixed size instead of carrying every distinct value."""
    if approx:
        return df.groupBy(*keys).agg(F.approx_count_distinct(col, rsd).alias(name))
    return df.groupBy(*keys).agg(F.countDistinct(col).alias(name))


def daily_bitmaps(df: DataFrame, day: Column, id_col: str) -> DataFrame:
    """(day, bucket, bits): the ids seen on each day as bitmaps of 32,768 ids (W32). Meant to be stored:
    days are added or recomputed one by one, and any longer period is counted from the bitmaps alone.

    Ids are whole numbers, dense ones for small bitmaps (a bitmap has 4 KB however many ids are in it).
    Null ids and null days are left out, as ``count(DISTINCT)`` leaves out the former."""
    rows = df.select(day.alias("day"), F.col(id_col).cast("bigint").alias("_id")).where("day IS NOT NULL AND _id IS NOT NULL")
    return rows.groupBy("day", F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def distinct_rollup(bitmaps: DataFrame, period: str = "month", name: str = "n_distinct") -> DataFrame:
    """Exact distinct counts per day, per ``period`` and over all days from stored bitmaps (W32): bitmaps
    of a bucket are OR-ed (partial aggregation, 4 KB a bucket) and their bits are counted. One pass;
    ``level`` tells the three apart, ``start`` is the first day of the day or period."""
    b = bitmaps.withColumn("_period", F.trunc("day", period))
    ored = b.groupingSets([["bucket", "day"], ["bucket", "_period"], ["bucket"]], "bucket", "day", "_period").agg(
        F.bitmap_or_agg("bits").alias("_bits"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, "day").when(F.col("_g") == 2, period).otherwise("all")
    return (ored.groupBy(level.alias("level"), F.coalesce("day", "_period").alias("start"))
            .agg(F.sum(F.bitmap_count("_bits")).cast("bigint").alias(name)))


def distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations of ``cols``."""
    return df.select(*cols).distinct()


def conditional_counts(df: DataFrame, keys: list[str], cases: dict[str, Column]) -> DataFrame:
    """One count column per condition, all in a single pass."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in cases.items()])


def qualifying_groups(df: DataFrame, key: str, period: Column, type_col: str,
                      rule: Column, period_name: str = "month",
                      types=("deposit", "purchase", "withdrawal")) -> DataFrame:
    """Count keys per period whose per-(key, period) type counts satisfy ``rule``.

    One column ``<type>_count`` is counted per value in ``types`` (a single
    conditional pass); ``rule`` is written over those columns, e.g.
    ``deposit_count >= 2``.
    """
    per = (df.groupBy(F.col(key), period.alias(period_name))
           .agg(*[F.count_if(F.col(type_col) == t).alias(f"{t}_count") for t in types]))
    return (per.where(rule).groupBy(period_name)
            .agg(F.count(F.lit(1)).alias("customer_count")))


def share_of_parent(df: DataFrame, parent: list[str], child: list[str], measure: str,
                    child_name: str, parent_name: str | None, pct_name: str) -> DataFrame:
    """Child sum and its percent (DECIMAL(20,2)) of the parent sum.

    One grouping at (parent, child) grain, then a window sum over the
    parent on the *grouped* rows — no second scan and no self-join.
    """
    g = df.groupBy(*parent, *child).agg(F.sum(measure).cast("bigint").alias(child_name))
    total = F.sum(child_name).over(Window.partitionBy(*parent))
    out = g.withColumn(pct_name, percent(F.col(child_name), total))
    if parent_name:
        out = out.withColumn(parent_name, total.cast("bigint"))
    return out


def share_of_population(df: DataFrame, key: str, cond: Column, scale: int = 1,
                        names=("total_customer", "churn", "churn_perc")) -> DataFrame:
    """Distinct keys overall, *rows* meeting ``cond`` and their percent of the keys (W36, for tables
    with at most one such row per key); ``share_of_keys`` counts keys on both sides."""
    total, hits, pct = names
    return (df.agg(F.countDistinct(key).alias(total), F.count_if(cond).alias(hits))
            .withColumn(pct, percent(hits, total, scale)))


def share_of_keys(df: DataFrame, key: str, cond: Column, scale: int = 2,
                  names=("n_keys", "n_meeting", "percent")) -> DataFrame:
    """Distinct keys overall, distinct keys with a row meeting ``cond`` and their percent."""
    total, hits, pct = names
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(cond, F.lit(False))).alias("_hit"))
    return (per.agg(F.count(F.lit(1)).alias(total), F.count_if("_hit").alias(hits))
            .withColumn(pct, percent(hits, total, scale)))


def two_level_avg(df: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Average over keys of the per-key distinct count of ``counted``."""
    per = df.groupBy(key).agg(F.countDistinct(counted).alias("_n"))
    return per.agg(mean4("_n").alias(name))


def group_revenue(df: DataFrame, type_col: str, price: Column) -> DataFrame:
    """Items and revenue per item type (count x unit price)."""
    return (df.groupBy(type_col).agg(F.count(F.lit(1)).alias("n_items"))
            .withColumn("revenue", (F.col("n_items") * price).cast("bigint")))


def profit_after_cost(df: DataFrame, order_key: str, price: Column, distance: str,
                      rate: float = 0.30) -> DataFrame:
    """Sum over orders of (sum of item prices - mean(distance x rate)), rounded to cents."""
    per = df.groupBy(order_key).agg(
        (F.sum(price) - F.avg(F.col(distance) * F.lit(rate).cast("decimal(3,2)"))).alias("_p"))
    return per.agg(F.round(F.sum("_p"), 2).cast("decimal(38,2)").alias("profit"))


def weighted_vs_plain_avg(df: DataFrame, keys: list[str], num: str, den: str, ratio: str) -> DataFrame:
    """Truncating sum(num)/sum(den) beside the (misleading) mean of row ratios (W39). ``ratio`` has
    two decimal places; its mean is exact and rounded once."""
    return (df.groupBy(*keys)
            .agg(trunc_div(F.sum(num), F.sum(den)).alias("correct_avg"),
                 mean_exact(ratio, 2, 2).cast("decimal(12,2)").alias("incorrect_avg")))


def success_rate(df: DataFrame, key: str, id_col: str, fail_col: str) -> DataFrame:
    """(count(id) - count(failure marker)) / count(id) as a percent, per key."""
    return (df.groupBy(key)
            .agg(F.count(id_col).alias("_n"), F.count(fail_col).alias("_f"))
            .select(key, percent(F.col("_n") - F.col("_f"), F.col("_n")).alias("success_pct")))


def range_of(df: DataFrame, value: Column, name: str = "difference") -> DataFrame:
    """max - min of a value."""
    v = value
    return df.agg(F.round(F.max(v) - F.min(v), 4).alias(name))
