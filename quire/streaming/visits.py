"""Incremental visit summary (W57) with Structured Streaming.

Events arrive as a stream of files. Each micro-batch is reduced to one partial row per
visit (minimum of the start, sums of the counts, maximum of the purchase flag) and written
under ``batch_id=<id>`` in a changelog folder, overwriting that folder on a retry, so a
replayed batch is idempotent. All these aggregates can be merged, so ``read_summary`` gets
the visits by merging the partial rows and joining the campaigns: the result is that of the
batch operator for any order of the files, any number of files per batch and any lateness.
No event is dropped, no state is held between batches, and nothing per visit reaches the
driver. ``compact`` merges a changelog that has grown long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.funnel import ADD_TO_CART, CLICK, IMPRESSION, PURCHASE, VIEW
from quire.operators.joins import interval_join
from quire.session import checkpoint_dir
from quire.sources.views import event_view

OUTPUT = ["user_id", "visit_id", "visit_start_time", "page_views", "cart_adds", "purchase", "campaign_name",
          "impression", "click"]
COUNTS = ["page_views", "cart_adds", "impression", "click"]


def partial_visits(events: DataFrame) -> DataFrame:
    """One mergeable row per visit of some events (in the case-study shape)."""
    t = F.col("event_type")
    return events.groupBy("user_id", "visit_id").agg(
        F.min("event_time").alias("visit_start_time"),
        F.count_if(t == VIEW).alias("page_views"),
        F.count_if(t == ADD_TO_CART).alias("cart_adds"),
        F.max((t == PURCHASE).cast("int")).alias("purchase"),
        F.count_if(t == IMPRESSION).alias("impression"),
        F.count_if(t == CLICK).alias("click"))


def merge_visits(partials: DataFrame) -> DataFrame:
    """Partial rows of the same visits merged to one row per visit."""
    return partials.groupBy("user_id", "visit_id").agg(
        F.min("visit_start_time").alias("visit_start_time"), F.max("purchase").alias("purchase"),
        *[F.sum(c).alias(c) for c in COUNTS])


def changelog_writer(path: str):
    """foreachBatch function: reduce one micro-batch and write it idempotently."""
    def write(batch: DataFrame, batch_id: int) -> None:
        partial_visits(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_summary(spark: SparkSession, path: str, campaigns: DataFrame) -> DataFrame:
    """The visit summary of all batches of a changelog."""
    visits = merge_visits(spark.read.parquet(path))
    return interval_join(visits, campaigns, "visit_start_time", "start_date", "end_date").select(*OUTPUT)


def compact(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A changelog merged into one batch of a new folder, with the same summary. Run it while no
    stream writes to ``path``."""
    merge_visits(spark.read.parquet(path)).write.mode("errorifexists").parquet(f"{target}/batch_id=0")
    return spark.read.parquet(target)


def run_visit_summary(spark: SparkSession, source: str, campaigns: DataFrame, out_dir: str | None = None,
                      glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Replay the event files of ``source`` (a Parquet file or folder; ``glob`` narrows the names)
    as a stream (available-now trigger) and return the resulting visit summary.

    Checkpoint and changelog live in the shared folder (``spark.checkpoint.dir``)
    unless ``out_dir`` is given, so a restarted driver resumes where it stopped.
    """
    base = out_dir or f"{checkpoint_dir(spark).rstrip('/')}/streams/visit_summary-{uuid.uuid4().hex}"
    options = {"pathGlobFilter": glob} if glob else {}
    schema = spark.read.options(**options).parquet(source).schema
    reader = spark.readStream.schema(schema).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern that matches the one name: a stream takes a single file only by a pattern
    name = source.rstrip("/")
    q = (event_view(reader.parquet(f"{name[:-1]}[{name[-1]}]")).writeStream
         .foreachBatch(changelog_writer(f"{base}/changelog"))
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_summary(spark, f"{base}/changelog", campaigns)
