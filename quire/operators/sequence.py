"""Row number, previous and next values per key by an ordered scan over ranges.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task, and no
re-planning splits a window. ``sequence`` cuts the order (key, order columns) inside every
key that holds more than a small share of the rows, numbers and shifts the rows inside
each (key, range), and adds what a range needs from its neighbours: the number of rows
before it, the last row of the range before and the first row of the range after, one
carry row per range, prefix-summed over the ranges of the key. A hot key may have unique
order values or a few: its ranges hold about as many rows each either way (rows that agree
in all order columns stay together).

The table is shuffled once. The cuts come from a sample, the carries from a partial
aggregation of the rows of cut keys; both are uncorrelated scalar subqueries with one array
entry per range, and nothing is joined to the table. Natural keys, such as an order's lines,
need none of it: the keys of a sample are counted when the query is built (one small job;
none for small tables), and where no key is hot the plan is one window.

The result equals ``row_number`` / ``lag`` / ``lead`` over the key's window whatever the
sample holds; ``order`` must make a total order inside each key. Null keys and null order
values are values like any other, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranges import MAX_RANGES, SAMPLE_PER_RANGE, drawn, estimated_rows, quantiles, sampled, search

RANGES_PER_TASK = 8        # a range holds so small a part of a task's share of the rows
MIN_HOT_ROWS = 50_000      # keys with fewer rows, by estimate, are left whole
DOUBT = 8                  # an estimate of rows may be too low by so much


def range_count(df: DataFrame) -> int:
    """Number of ranges that the table is thought to have: some for each shuffle partition."""
    return max(2, min(MAX_RANGES, RANGES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def has_hot_key(df: DataFrame, keys: list[str], ranges: int) -> bool:
    """Whether a key of a sample holds more than two of ``ranges`` equal parts of it, and enough rows."""
    rows = estimated_rows(df)
    if rows is not None and DOUBT * rows < MIN_HOT_ROWS:
        return False
    counts = sampled(df.select(*keys), SAMPLE_PER_RANGE * ranges).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    if not total or most * ranges <= 2 * total:
        return False
    return rows is None or DOUBT * rows * most >= MIN_HOT_ROWS * total


def hot_cuts(df: DataFrame, place: Column, ranges: int) -> Column:
    """Sorted array of fewer than ``ranges`` values of ``place`` (a struct with the key as ``k``) that cut
    every key with more than two of ``ranges`` equal parts of the rows into such parts, as a scalar
    subquery over a sample whose size depends on ``ranges`` alone. Other keys have no cut."""
    at = drawn(df, place, ranges).select(quantiles(ranges).alias("ps"))

    def inside(p, i):  # the key is also at the quantile before or after
        return (i > 0) & (i < ranges) & ((F.get("ps", i - 1)["k"] == p["k"]) | F.coalesce(F.get("ps", i + 1)["k"] == p["k"], F.lit(False)))

    return at.select(F.array_distinct(F.filter("ps", inside)).alias("cuts")).scalar()


def in_ranges(df: DataFrame, splits: Column, place: Column, key: Column, ranges: int) -> DataFrame:
    """Add ``_b``, the range of a row, and whether its key is that of the split point at the start
    (``_in``) or at the end (``_out``) of the range: a key that crosses ranges is."""
    def held(i):
        return F.coalesce(F.get("_splits", i)["k"] == key, F.lit(False))

    return search(df, splits, place, ranges, "_b").withColumns({"_in": held(F.col("_b") - 1), "_out": held(F.col("_b"))}).drop("_splits")


def sequence(df: DataFrame, keys: list[str], order: list[str], lag_cols: list[str] = (),
             lead_cols: list[str] = (), rn_name: str = "rn", keep: list[str] | None = None) -> DataFrame:
    """Add ``rn_name``, ``prev_<c>`` for each of ``lag_cols`` and ``next_<c>`` for each of
    ``lead_cols``; ``keep`` names the columns to carry besides keys and shifted ones."""
    keys, order, lag_cols, lead_cols = list(keys), list(order), list(lag_cols), list(lead_cols)
    ranges = range_count(df)
    carried = list(dict.fromkeys((keep or df.columns) + keys + lag_cols + lead_cols))
    if not has_hot_key(df, keys, ranges):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select(*carried, F.row_number().over(w).cast("long").alias(rn_name), *[F.lag(c).over(w).alias(f"prev_{c}") for c in lag_cols],
                         *[F.lead(c).over(w).alias(f"next_{c}") for c in lead_cols])
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    place = F.struct(key.alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    cut = in_ranges(df, hot_cuts(df, place, ranges), place, key, ranges)
    carry = _carries(cut, keys, order, lag_cols, lead_cols, ranges)

    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    shifted = {"_i": F.row_number().over(inside), **{f"_lag{j}": F.lag(c).over(inside) for j, c in enumerate(lag_cols)},
               **{f"_lead{j}": F.lead(c).over(inside) for j, c in enumerate(lead_cols)}}
    if lead_cols:
        shifted["_n"] = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_b"))
    d, at = cut.withColumns(shifted).withColumn("_carry", F.when(F.col("_in") | F.col("_out"), F.get(carry, F.col("_b")))), F.col("_carry")
    before = F.when(F.col("_in"), F.coalesce(at["before"], F.lit(0))).otherwise(0)
    return d.select(
        *carried, (before + F.col("_i")).cast("long").alias(rn_name),
        *[F.when(F.col("_in") & (F.col("_i") == 1), at["prev"][f"c{j}"]).otherwise(F.col(f"_lag{j}")).alias(f"prev_{c}")
          for j, c in enumerate(lag_cols)],
        *[F.when(F.col("_out") & (F.col("_i") == F.col("_n")), at["next"][f"c{j}"]).otherwise(F.col(f"_lead{j}")).alias(f"next_{c}")
          for j, c in enumerate(lead_cols)])


def _carries(cut: DataFrame, keys: list[str], order: list[str], lag_cols: list[str], lead_cols: list[str],
             ranges: int) -> Column:
    """Array with an entry per range: what the key that comes into it (``before``, ``prev``) and the key
    that goes on after it (``next``) need from other ranges, as a scalar subquery."""
    by, none = F.struct(*order), F.lit(None).cast("int")
    last = F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(lag_cols)]) if lag_cols else none
    first = F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(lead_cols)]) if lead_cols else none
    pieces = cut.where("_in OR _out").groupBy(*keys, "_b", "_in", "_out").agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by(last, by).alias("_last"), F.min_by(first, by).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_b")
    # at most two rows per range from here on
    pieces = pieces.coalesce(1).select(
        "_b", "_in", "_out", F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(w).alias("_prev"), F.lead("_first").over(w).alias("_next"))
    per = pieces.groupBy("_b").agg(F.max(F.when(F.col("_in"), F.col("_before"))).alias("before"),
                                   F.first(F.when(F.col("_in"), F.col("_prev")), ignorenulls=True).alias("prev"),
                                   F.first(F.when(F.col("_out"), F.col("_next")), ignorenulls=True).alias("next"))
    dense = cut.sparkSession.range(0, ranges, 1, 1).select(F.col("id").cast("int").alias("_r")).join(per, F.col("_r") == F.col("_b"), "left")
    return (dense.agg(F.sort_array(F.collect_list(F.struct("_r", "before", "prev", "next"))).alias("all"))
            .select(F.transform("all", lambda x: F.struct(x["before"].alias("before"), x["prev"].alias("prev"), x["next"].alias("next"))).alias("c"))
            .scalar())
