"""Ranges of a table's order: samples, split points, and the search for a row's range.

Split points and what else belongs to a range are arrays in uncorrelated scalar subqueries: Spark
computes them before the query that mentions them, from samples whose size depends on the number of
ranges alone, and every task has them without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 50      # rows drawn for each range, by estimate
MAX_RANGES = 20_000        # entries of an array of split points
COMPRESSION = 4            # bytes of a row over its bytes in the files, roughly
UNKNOWN_BYTES = 1 << 60    # what Spark gives as the size of a table it knows nothing about


def estimated_rows(df: DataFrame) -> int | None:
    """Rows of the tables that ``df`` reads, from the sizes of their files; None if unknown."""
    try:
        leaves, rows = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
        for i in range(leaves.size()):
            leaf, width = leaves.apply(i), 8
            size = int(str(leaf.stats().sizeInBytes()))
            if size >= UNKNOWN_BYTES:
                return None
            out = leaf.output()
            for j in range(out.size()):
                width += out.apply(j).dataType().defaultSize()
            rows = max(rows, COMPRESSION * size // width)
        return rows
    except (AttributeError, TypeError):  # no JVM plan at hand
        return None


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` random rows, by the estimated size of ``df``; where that is unknown its rows are
    counted. An estimate that is far too low cannot make the sample large."""
    estimate = estimated_rows(df)
    if estimate is None:
        total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
        return df.where(F.rand(17) * total < rows)
    return (df.sample(rows / estimate, 17) if estimate > rows else df).limit(64 * rows)


def value_ranges(df: DataFrame) -> int:
    """Number of ranges of about equal size to cut a table into: one for each shuffle partition."""
    return max(2, min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def quantiles(ranges: int) -> Column:
    """Entries 0 to ``ranges`` of the sorted array ``ps`` at equal distances; the last is null."""
    return F.transform(F.sequence(F.lit(0), F.lit(ranges)), lambda i: F.get(F.col("ps"), F.floor(i * F.size("ps") / ranges).cast("int")))


def drawn(df: DataFrame, place: Column, ranges: int) -> DataFrame:
    """One row: ``ps``, the sorted ``place`` of a sample whose size depends on ``ranges`` alone."""
    return sampled(df, SAMPLE_PER_RANGE * ranges).select(place.alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps"))


def split_points(df: DataFrame, place: Column, ranges: int) -> Column:
    """Sorted array of fewer than ``ranges`` values of ``place`` that cut ``df`` into ranges of about equal
    size, as a scalar subquery. A value that fills several ranges is there once."""
    at = drawn(df, place, ranges).select(quantiles(ranges).alias("ps"))
    return at.select(F.array_distinct(F.filter(F.slice("ps", 2, ranges - 1), lambda p: p.isNotNull())).alias("splits")).scalar()


def search(df: DataFrame, splits: Column, place: Column, ranges: int, out: str) -> DataFrame:
    """Add ``out``, the number of entries of ``splits`` (fewer than ``ranges``, sorted) at or below
    ``place``, and ``_splits`` itself: a binary search, one projection per step, in generated code.
    ``_splits`` is the same object in all rows and must be dropped before they are shuffled. A null
    place is in range 0."""
    d = df.withColumns({"_splits": splits, "_place": place, out: F.lit(0)})
    for step in [1 << i for i in reversed(range(max(1, (ranges - 1).bit_length())))]:
        # beyond the last split point there is null, which counts as above. Each mention of ``out`` counts: Spark's
        # rule for dynamic pruning follows a join key down the steps, and its copy grows as mentions ** steps
        d = d.withColumn(out, F.col(out) + F.when(F.get("_splits", F.col(out) + (step - 1)) <= F.col("_place"), step).otherwise(0))
    # an expression that is not deterministic keeps filters and semi-joins above it: pushed down, they
    # would repeat the whole search for each mention of its result
    return d.withColumn(out, F.when(F.spark_partition_id() >= 0, F.col(out))).drop("_place")
