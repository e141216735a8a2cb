"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, the component being its smallest node.

    Alternates large-star and small-star steps: every node points its larger (then its smaller)
    neighbours to the smallest node it knows, until nothing changes. A step is a partially
    aggregated minimum and a join, so a node with very many neighbours is never gathered; each
    round's edges are written to the shared folder. Loops, repeated and reversed edges are allowed.
    """
    e = stage(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .distinct(), "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        e = stage(_small_star(_large_star(e)), "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def _mark(e: DataFrame):
    """Number and hash sum of the edges."""
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    to = e.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
    return (to.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(to.select("u", F.col("m").alias("v")))
            .filter("u != v").distinct())
