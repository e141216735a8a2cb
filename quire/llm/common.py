"""Helpers shared by the operators: stage tables in the shared folder, word counts, running sums."""

from __future__ import annotations

import gc
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.session import checkpoint_dir

# a word is a run of characters other than space and U+0009..U+000D
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut, the work is not
    done again by a second reader, and the copy survives the loss of an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of work whose result is in a stage table. Spark removes them when
    the driver's JVM collects the plans that made them, which may otherwise be long after. The events
    of a job just ended hold its plan until the listeners have had them, hence the second collection."""
    gc.collect()
    for wait in (1, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda variable is bound to its
    result, whereas a repeated sub-expression inside a lambda is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def random_key(*parts: Column) -> Column:
    """A hash-random long of 60 bits that any engine with md5 can reproduce."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


ROWS_PER_BUCKET = 4096


def running_sum(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``group`` in the order of (``key``, ``ties``).

    ``key`` is a hash-random long of 60 bits. Its high bits cut every group into ranges, so many that
    a range of a group that held all rows would have about ``ROWS_PER_BUCKET``: a group with a third
    of all rows is sorted by many tasks. The sums of whole ranges are prefix-summed on the small
    range table and added to the running sum inside each range. ``df`` should be a stage table, as it
    is read three times.
    """
    bits = max(0, math.ceil(math.log2(max(1, df.count()) / ROWS_PER_BUCKET)))
    cut = df.withColumn("_bucket", F.shiftright(key, 60 - bits))
    ranges = (cut.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b"))
              .agg(F.sum(value).alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(
                  Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_sum"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(ranges, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
            .withColumn(out, (F.col("_before") + F.col("_run")).cast("long"))
            .drop("_g", "_b", "_bucket", "_run", "_before"))


def arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType.fromDDL(ddl))
