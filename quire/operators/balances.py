"""Closing balances that are stored and kept up by deltas (W51 with W11).

The store is a table of one row per (key, month), partitioned by a hash bucket of the key. A batch of
late transactions touches the buckets of its keys alone: other buckets are neither read nor written, and
inside the touched ones only the changed keys are computed again, from their first changed month on, with
the closing balance before it as the carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.windows import period_balance
from quire.sources.sinks import materialize

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def store_balances(txns: DataFrame, path: str, key: str, date_col: str, value: str, buckets: int = BUCKETS) -> None:
    """Write ``period_balance`` of ``txns`` as a new store at ``path``."""
    table = period_balance(txns, key, date_col, value).withColumn("bucket", _bucket(key, buckets))
    table.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merged_balances(stored: DataFrame, late: DataFrame, key: str, date_col: str, value: str,
                    buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """The rows of the touched buckets after a batch of late transactions, and these buckets.

    The buckets come to the driver (``buckets`` at most) so that the read of the store is pruned by them
    when it is planned. The batch may hold new keys, new months and any number of rows of a key; it is
    summed per (key, month) before it meets the store. Null keys stay apart from all others."""
    delta = materialize(late.groupBy(key, F.trunc(date_col, "month").cast("date").alias("month"))
                        .agg(F.sum(value).alias("monthly_balance")).withColumn("bucket", _bucket(key, buckets)), "late-balances")
    touched = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
    part = stored.where(F.col("bucket").isin(touched))
    first = delta.groupBy(F.col(key).alias("_key")).agg(F.min("month").alias("_first"))
    marked = part.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_old", F.col("_first").isNull() | (F.col("month") < F.col("_first")))
    columns = [key, "month", "monthly_balance", "closing_balance", "bucket"]
    kept = marked.where("_old").select(columns)
    carry = (marked.where("_old AND _first IS NOT NULL").groupBy(F.col(key).alias("_of"))
             .agg(F.max_by("closing_balance", "month").alias("_carry")))
    cells = (marked.where("NOT _old").select(key, "month", "monthly_balance", "bucket").unionByName(delta)
             .groupBy(key, "month", "bucket").agg(F.sum("monthly_balance").alias("monthly_balance")))
    run = F.sum("monthly_balance").over(Window.partitionBy(key).orderBy("month"))
    kind = stored.schema["closing_balance"].dataType
    again = (cells.withColumn("_run", run).join(carry, F.col(key).eqNullSafe(F.col("_of")), "left")
             .withColumn("closing_balance", (F.coalesce("_carry", F.lit(0)) + F.col("_run")).cast(kind))
             .withColumn("monthly_balance", F.col("monthly_balance").cast(stored.schema["monthly_balance"].dataType)).select(columns))
    return kept.unionByName(again), touched


def merge_late(spark: SparkSession, path: str, late: DataFrame, key: str, date_col: str, value: str,
               buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the store at ``path``; returns the buckets written. The new rows are written to a
    table of their own first, then replace the partitions of their buckets, so an interrupted batch
    can be merged again from the start as long as the second write has not begun."""
    rows, touched = merged_balances(spark.read.parquet(path), late, key, date_col, value, buckets)
    if touched:
        done = materialize(rows, "merged-balances")
        (done.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    return touched
