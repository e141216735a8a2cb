"""Join operators.

No join carries a broadcast hint: adaptive execution broadcasts sides whose
*measured* shuffle output is small. It splits a skewed join only if nothing
above the join needs the same key again, so operators that join and then group
or rank by one key first reduce the fact to one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ranges import estimated_rows, search, split_points

def enrich_total(fact: DataFrame, keys: list[str], measure: str,
                 dims: list[tuple[DataFrame, list[str]]] = (),
                 total_name: str = "total_amount", count_name: str = "n_items") -> DataFrame:
    """Join dimensions onto a fact, then sum and count the measure per key.

    The aggregate runs partial (map-side) then final, so a hot key costs one
    row per map task in the shuffle.
    """
    df = fact
    for dim, on in dims:
        df = df.join(dim, on)
    return (df.groupBy(*keys)
            .agg(F.sum(measure).cast("decimal(38,2)").alias(total_name),
                 F.count(F.lit(1)).alias(count_name)))


def _edge_dates(fact: DataFrame, starts: DataFrame, key: str, date_col: str, start_col: str, after: bool) -> DataFrame:
    """(key, date): the first date on/after or the last date before each key's start. The fact is
    reduced to its (key, date) pairs before it meets the starts, so a hot key brings its days."""
    days = fact.select(key, date_col).distinct().join(starts.select(key, start_col), key)
    if after:
        return days.where(F.col(date_col) >= F.col(start_col)).groupBy(key).agg(F.min(date_col).alias(date_col))
    return days.where(F.col(date_col) < F.col(start_col)).groupBy(key).agg(F.max(date_col).alias(date_col))


def first_after(fact: DataFrame, starts: DataFrame, key: str = "customer_id",
                date_col: str = "order_date", start_col: str = "join_date") -> DataFrame:
    """Rows on the first date on/after each key's start date, ties kept.

    ``starts`` has one row per key. The rows come back by a join on (key, date)."""
    return fact.join(_edge_dates(fact, starts, key, date_col, start_col, True), [key, date_col], "left_semi")


def last_before(fact: DataFrame, starts: DataFrame, key: str = "customer_id",
                date_col: str = "order_date", start_col: str = "join_date") -> DataFrame:
    """Rows on the last date strictly before each key's start date, ties kept."""
    return fact.join(_edge_dates(fact, starts, key, date_col, start_col, False), [key, date_col], "left_semi")


def total_before(fact: DataFrame, starts: DataFrame, measure: str = "price", key: str = "customer_id",
                 date_col: str = "order_date", start_col: str = "join_date") -> DataFrame:
    """Count and sum of the measure strictly before each key's start date (W24), from per-day sums."""
    days = fact.groupBy(key, date_col).agg(F.count(F.lit(1)).alias("_n"), F.sum(measure).alias("_sum"))
    return (days.join(starts.select(key, start_col), key).where(F.col(date_col) < F.col(start_col))
            .groupBy(key)
            .agg(F.sum("_n").alias("n_items"), F.sum("_sum").cast("decimal(38,2)").alias("total_amount")))


def flag_since(fact: DataFrame, starts: DataFrame, key: str = "customer_id",
               date_col: str = "order_date", start_col: str = "join_date",
               flag: str = "member") -> DataFrame:
    """Left join of start dates; 'Y' when the row is on/after the start, else 'N' (W25)."""
    return (fact.join(starts.select(key, start_col), key, "left")
            .withColumn(flag, F.when(F.col(date_col) >= F.col(start_col), "Y").otherwise("N"))
            .drop(start_col))


def rank_flagged(fact: DataFrame, starts: DataFrame, order_cols: list[str], key: str = "customer_id",
                 date_col: str = "order_date", start_col: str = "join_date",
                 flag: str = "member", rank_name: str = "ranking") -> DataFrame:
    """W25 plus a running number of the 'Y' rows per key; NULL for 'N' rows.

    ``order_cols`` must make the order total so the numbering is repeatable;
    the numbering is a two-level ``sequence`` over (key, flag).
    """
    from quire.operators.sequence import sequence
    df = flag_since(fact, starts, key, date_col, start_col, flag)
    s = sequence(df, [key, flag], order_cols, rn_name="_rn")
    return s.withColumn(rank_name, F.when(F.col(flag) == "Y", F.col("_rn").cast("int"))).drop("_rn")


def semi_join_keys(df: DataFrame, marker: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key appears in ``marker`` (W27): EXISTS as a left-semi join."""
    return df.join(marker.select(*keys), keys, "left_semi")


def anti_join_keys(df: DataFrame, marker: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key never appears in ``marker``.

    NULL marker keys are dropped first: a NULL inside ``NOT IN`` would
    otherwise empty the result, and the plain anti join can be a shuffled
    (skew-splittable) join instead of the broadcast-only null-aware form.
    """
    m = marker.select(*keys).dropna()
    return df.join(m, keys, "left_anti")


def missing_in_range(df: DataFrame, col: str, lo: int, hi: int, name: str | None = None) -> DataFrame:
    """Numbers of [lo, hi] that never occur in ``df[col]``.

    The range has a fixed, proven size (hi - lo + 1 rows) and the present
    values are first reduced to distinct ones, so neither side grows with
    the data.
    """
    name = name or col
    present = df.select(F.col(col).cast("bigint").alias(name)).where(F.col(name).between(lo, hi)).distinct()
    rng = df.sparkSession.range(lo, hi + 1).select(F.col("id").alias(name))
    return rng.join(present, name, "left_anti")


MAX_SLOTS = 4096      # slots that the end points of the intervals cut the line into
FILED_PER_INTERVAL = 16


def interval_join(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Left join of points to every closed interval [start, end] holding them.

    Unmatched points are kept with NULL interval columns; a point inside
    overlapping intervals appears once per interval; an interval that ends
    before it starts, or has a null end, holds nothing.

    One plan for all sizes. The intervals' own end points cut the line into slots
    with about equally many end points each, however they are spread; a point
    finds its one slot by binary search in the task that reads it, an interval
    is filed under the slots it touches. What is left is one left equi-join on
    the slot: the points are shuffled once at most (not at all where the filed
    intervals are measured small enough to broadcast), a hot slot's points are
    split by the skew-join handling, and a point meets, besides the intervals
    that hold it, only those that end or start in its slot. Where intervals are
    so long that they touch more than ``FILED_PER_INTERVAL`` slots each on
    average, neighbouring slots are merged until they do not.
    """
    good = intervals.where(F.col(start) <= F.col(end))
    ends = good.select(F.explode(F.array(start, end)).alias("t"))
    known = estimated_rows(good)
    slots = MAX_SLOTS if known is None else min(MAX_SLOTS, max(16, 1 << (2 * known).bit_length()))
    splits = split_points(ends, F.col("t"), slots)

    def placed(df, at, out):
        return search(df, splits, F.col(at), slots, out).drop("_splits")

    filed, at = placed(placed(good, start, "_a"), end, "_z"), placed(points, ts, "_own")
    if slots > FILED_PER_INTERVAL:
        touched = filed.agg(F.sum(F.col("_z") - F.col("_a") + 1).alias("s"), F.count(F.lit(1)).alias("n"))
        stride = F.coalesce(touched.select(F.greatest(F.lit(1), F.ceil(F.col("s") / (FILED_PER_INTERVAL * F.col("n")))).cast("int")).scalar(), F.lit(1))
        filed = filed.withColumns({c: F.floor(F.col(c) / stride).cast("int") for c in ("_a", "_z")})
        at = at.withColumn("_own", F.floor(F.col("_own") / stride).cast("int"))
    filed = filed.withColumn("_slot", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    return (at.join(filed, (F.col("_own") == F.col("_slot")) & (at[ts] >= filed[start]) & (at[ts] <= filed[end]), "left")
            .drop("_own", "_slot"))
