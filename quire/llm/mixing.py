"""Mixing sources to target weights (operator 2).

Every document gets a hash-random key. Each source is range-sorted by that key, a distributed
prefix sum of the document sizes is taken in that order, and the source is cut where the sum
reaches the source's budget; a budget above the source's size takes the whole source once and
goes on with a second pass in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import random_key, running_sum, stage, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5        # the mix's size as a multiple of all sizes
MAX_EPOCHS = 2     # a source is taken twice at most


def source_key(source: Column) -> Column:
    """Sorts sources by code point, null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def targets(sources: DataFrame, group: str, size: str, weights: tuple = WEIGHTS,
            share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table of one row per source.

    Weights repeat over the sources in the order of ``group``. The total is ``share`` times all
    sizes; a source's target stops at ``max_epochs`` times its size and what it cannot take goes to
    the others by weight until none is above: a source is capped when its share of what the sources
    before it (by cap per weight) leave is at least its cap.
    """
    by_key = Window.orderBy(group)
    cap = (F.col(size) * max_epochs).cast("double")
    s = (sources.withColumn("_i", F.row_number().over(by_key) - 1)
         .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights)).cast("int") + 1))
         .withColumn("_cap", cap))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum(size).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    w_left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    s = s.withColumn("_full", left * F.col("_w") >= F.col("_cap") * w_left)
    rest = F.lit(share) * F.sum(size).over(whole) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    rest_w = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(whole)
    return (s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * rest / rest_w))
            .drop("_i", "_w", "_cap", "_full"))


def mix(rows: DataFrame, group: str, size: str, ties: list[str], seed: str = "mix", weights: tuple = WEIGHTS,
        share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to a narrow table of documents.

    ``taken`` is the number of words that the mix takes from the document, repeats counted: the
    document's part of ``[0, budget)`` over as many passes as the budget needs, the budget being the
    target rounded to a whole number. Sizes of 0 take 0. Rows that tie in key and in ``ties`` are
    interchangeable. An empty table gives an empty table.
    """
    keyed = stage(rows.withColumn("_key", random_key(F.lit(seed), *[F.col(c) for c in ties])), "mix-sizes")
    sources = (keyed.groupBy(F.col(group).alias("_source")).agg(F.sum(size).alias("source_size")))
    budgets = targets(sources, "_source", "source_size", weights, share, max_epochs)
    cut = running_sum(keyed, group, "_key", ties + [size], size, "_start")
    budget = F.floor(F.col("target") + 0.5)
    taken = sum((F.greatest(F.lit(0), F.least(F.col(size), budget - e * F.col("source_size") - F.col("_start")))
                 for e in range(max_epochs)), F.lit(0))
    return (cut.join(budgets, F.col(group) == F.col("_source"))
            .withColumn("taken", taken.cast("long")).drop("_source", "_start", "_key"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("_group"), word_count(F.col("text")).alias("size"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with size, source_size, target and taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return (mix(sizes(docs), "_group", "size", ["doc_id"])
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix_documents(docs: DataFrame, row_id: str, seed: str = "mix") -> DataFrame:
    """The mix as documents: every document as often as the mix takes it, rounded to whole
    documents (half and more of a document's words count as one copy; documents without words are
    kept once). ``row_id`` and the text name a row, and the result has the columns of ``docs``."""
    text_hash = F.xxhash64("text")
    narrow = docs.select(F.col(row_id), source_key(F.col("source")).alias("_group"), text_hash.alias("_text"),
                         word_count(F.col("text")).alias("_size"))
    plan = mix(narrow, "_group", "_size", [row_id, "_text"], seed)
    copies = F.when(F.col("_size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("_size") + 0.5)).cast("int")
    plan = plan.select(F.col(row_id).alias("_id"), "_text", copies.alias("_copies")).filter("_copies > 0")
    return (docs.join(plan, (F.col(row_id) == F.col("_id")) & (text_hash == F.col("_text")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT g, sum(size) AS source_size, row_number() OVER (ORDER BY g) - 1 AS i FROM d GROUP BY g),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CAST(2 * source_size AS DOUBLE) AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) * w >= cap * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS capped
      FROM w WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT g, CAST(source_size AS BIGINT) AS source_size,
             CASE WHEN capped THEN cap
                  ELSE w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
                         / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
p AS (SELECT doc_id, g, size, coalesce(sum(size) OVER (PARTITION BY g ORDER BY k, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target + 0.5) - start))
          + greatest(0, least(size, floor(target + 0.5) - source_size - start)) AS BIGINT) AS taken
FROM p JOIN t USING (g)
"""
