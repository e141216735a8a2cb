"""Filter interaction audit (operator 13): what every order of a set of filters removes at every step.

A document is only its part, its set of failed filters and its weights, so Spark reduces the table to
one row per part with a weight for each of the 2^k failure masks. The rest is a min-plus product:
the mask matrix holds 0 where a mask fails a filter and infinity elsewhere, the position matrix holds
each filter's place in each order (the inverse permutation), and the minimum over the filters of
their sum is the step at which the order removes the mask (infinity: never). Removed, redundant and
lost counts are scatters of the weights by that step.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import WORD

SPACE_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
MAX_FILTERS = 7  # 7! orders, 2^7 masks


def text_failures(text: Column) -> dict[str, Column]:
    """The four failure conditions that a text decides by itself; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame, text_rules: dict[str, Column], copies: str = "E",
             id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, one boolean per filter, n, good, toxic): documents counted by part and failed filters.

    ``copies`` names the filter that fails when another row with a smaller id has the same text (null
    texts count as empty). Rows with one id are one document there: none of them is a copy of the
    other. Rows without an id never fail it, make no other row fail it and have no labels. Of several
    label rows of an id one that says 1 is enough; labels of unknown ids count for nothing.

    Texts are read once and do not move: they are named by 128 bits of hash. Groups of copies, however
    large, are only ever summed and minimised, per part first, so no task gathers them.
    """
    names = list(text_rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(13), text, F.length(text)).alias("h2"),
                       F.struct(*[text_rules[c].alias(c) for c in names]).alias("rules"))
    judged = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
              .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
                   F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic")))
    weights = ("n", "good", "toxic")
    weighed = (rows.filter("id IS NOT NULL").groupBy("id", "h1", "h2", "part", "rules").agg(F.count(F.lit(1)).alias("n"))
               .join(judged, "id", "left")
               .select("id", "h1", "h2", "part", "rules", "n",
                       *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]))
    by_text = (weighed.groupBy("h1", "h2", "part", "rules")
               .agg(F.min("id").alias("first"), F.min_by(F.struct(*weights), "id").alias("at_first"),
                    *[F.sum(c).alias(c) for c in weights]))
    # a text has at most one row per part by now
    least = F.min("first").over(Window.partitionBy("h1", "h2"))
    known = by_text.withColumn("single", F.when(F.col("first") == least, F.col("at_first")))

    def single(c):  # those that are no copies
        return F.coalesce(F.col("single")[c], F.lit(0))

    counted = known.select("part", "rules.*", F.explode(F.array(
        F.struct(F.lit(False).alias(copies), *[single(c).alias(c) for c in weights]),
        F.struct(F.lit(True).alias(copies), *[(F.col(c) - single(c)).alias(c) for c in weights]))).alias("x"))
    nameless = (rows.filter("id IS NULL").groupBy("part", "rules").agg(F.count(F.lit(1)).alias("n"))
                .select("part", "rules.*", F.lit(False).alias(copies), "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))
    return (counted.select("part", *names, "x.*").filter("n > 0").unionByName(nameless)
            .groupBy("part", *names, copies).agg(*[F.sum(c).alias(c) for c in weights]))


def removal_steps(k: int):
    """(orders, steps, positions): all orders of k filters as rows of filter numbers; the step (from 0)
    at which each order removes each failure mask (k: never); each filter's place in each order."""
    import numpy as np

    orders = np.array(list(itertools.permutations(range(k))), dtype=np.int64).reshape(-1, k)
    positions = np.argsort(orders, axis=1)  # the inverse permutations
    masks = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    never = np.where(masks == 1, 0, k)
    steps = np.minimum((never[None, :, :] + positions[:, None, :]).min(axis=2), k)
    return orders, steps, positions


def audit(counts: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order and step from rows (part, one boolean per filter, n, good, toxic).

    ``counts`` may hold a combination more than once. Every part has all k! orders and k steps, zeros
    included. k is at most ``MAX_FILTERS``.
    """
    k = len(filters)
    if not 0 < k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    mask = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0))
    weights = ("n", "good", "toxic")
    cells = counts.groupBy("part", mask.cast("int").alias("mask")).agg(*[F.sum(c).alias(c) for c in weights])
    # at most 2^k cells meet in a row of a part
    wide = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *weights)).alias("cells"))

    def measure(batches):
        import numpy as np
        import pyarrow as pa

        orders, steps, positions = removal_steps(k)
        n_orders = len(orders)
        names = ["".join(filters[f] for f in o) for o in orders]
        fails = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(np.int64)
        row = np.repeat(np.arange(n_orders), 1 << k)
        cell = row * (k + 1) + steps.ravel()

        def scatter(weight):  # what each order removes at each step; the last column is what stays
            out = np.zeros(n_orders * (k + 1), dtype=np.int64)
            np.add.at(out, cell, np.tile(weight, n_orders))
            return out.reshape(n_orders, k + 1)

        for b in batches:
            for part, cells_of in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                w = np.zeros((len(weights), 1 << k), dtype=np.int64)
                for c in cells_of:
                    w[:, c["mask"]] += [c[x] for x in weights]
                removed, good, toxic = (scatter(x)[:, :k] for x in w)
                failing = w[0] @ fails                      # documents that fail each filter
                only = w[0][1 << np.arange(k)]              # those that fail nothing else
                by_filter = np.take_along_axis(removed, positions, axis=1)
                shapley = by_filter.sum(axis=0)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * (n_orders * k), pa.string()),
                    "filter_order": pa.array(np.repeat(names, k).tolist(), pa.string()),
                    "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n_orders)),
                    "kept": pa.array((w[0].sum() - np.cumsum(removed, axis=1)).ravel()),
                    "removed": pa.array(removed.ravel()),
                    "redundant": pa.array((failing[orders] - removed).ravel()),
                    "unique_fails": pa.array(only[orders].ravel()),
                    "good_lost": pa.array(good.ravel()),
                    "toxic_lost": pa.array(toxic.ravel()),
                    "shapley": pa.array(shapley[orders].ravel()),
                })

    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                           T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in longs]])
    return wide.mapInArrow(measure, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the audit of five text filters over all documents, per source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    counts = failures(docs, labels, text_failures(F.col("text")))
    return audit(counts, ["A", "B", "C", "D", "E"])


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, CAST(len(ws) < {MIN_WORDS} AS INT)
             + 2 * CAST(100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws) AS INT)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '{SYMBOLS}') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask,
             coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)),
o AS (SELECT a.name || b.name || x.name || y.name || z.name AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
      FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND (a.bit | b.bit | x.bit | y.bit | z.bit) = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS earlier
      FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (WHERE mask & (bit | CAST(earlier AS INT)) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & CAST(earlier AS INT) > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
