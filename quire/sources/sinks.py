"""Sinks: materialise a derived table (W10) and append rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint_dir


def materialize(df: DataFrame, name: str, how: str = "parquet", partition_by: list[str] | None = None,
                path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Keep a derived table for later steps and return a DataFrame over it.

    ``how``:
      * ``view``       register a temp view (lazy; nothing is written)
      * ``parquet``    write to the shared folder and read it back — this
                       cuts the lineage, so a lost executor re-reads files
                       instead of recomputing the upstream plan
      * ``checkpoint`` reliable ``DataFrame.checkpoint`` in ``spark.checkpoint.dir``

    ``mode='append'`` adds the rows to an existing table at ``path`` (the
    append-a-query-result sink); the returned frame reads the whole table.
    """
    spark = df.sparkSession
    if how == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if how == "checkpoint":
        checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    if how != "parquet":
        raise ValueError(how)
    target = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    if mode == "append" and path is None:
        raise ValueError("append needs the path of the table to append to")
    if partition_by:
        # rows of one partition value meet in few tasks, so a value gets few files; a large value is
        # split again by adaptive execution (rebalance), not left to one task
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    return spark.read.parquet(target)


def co_partition(df: DataFrame, name: str, keys: list[str], buckets: int, sort_by: list[str] | None = None,
                 path: str | None = None) -> DataFrame:
    """Keep a table in the catalogue, hash-bucketed by ``keys`` and sorted inside each bucket (W10), and
    return a DataFrame over it. Tables with the same number of buckets on keys of the same types join,
    group and window on these keys without any exchange, and merge-join without a sort when there
    is one file per bucket, which the repartitioning before the write makes sure of.

    The files go to the shared folder (or ``path``), not to the machine-local default warehouse. An
    existing table of the name is replaced. Choose ``buckets`` so that one bucket of the largest table
    fits a task; a key that holds much more than that is better joined by a plain, skew-handled join."""
    spark = df.sparkSession
    target = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    w = (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", target)
         .bucketBy(buckets, *keys).sortBy(*(sort_by or keys)))
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    w.saveAsTable(name)
    return spark.table(name)


def append_rows(base: DataFrame, *new: DataFrame) -> DataFrame:
    """UNION ALL by column name; new frames are cast to the base schema."""
    out = base
    for n in new:
        out = out.unionByName(n.select(*[F.col(f.name).cast(f.dataType) for f in base.schema.fields]))
    return out
