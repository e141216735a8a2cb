"""Line deduplication (operator 9), DataFrame functions only.

Hashes of long lines are range-partitioned with a secondary sort by document (largest first) and
position, and the first occurrence of each hash in each document is streamed off the sorted rows.
What travels back is a compressed keep bitmap per document (run lengths), never text: the only
step that reads texts again is the one that applies the bitmaps.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import let, stage

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
SHARDS = 64  # a hash is dealt to so many sort groups, so a line that a third of all documents hold is split


def split_lines(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (other letters as they are)."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def long_lines(docs: DataFrame, id_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, text_hash, pos) of every line whose key has ``min_chars`` code points or more; the
    96 bits of h1 and h2 stand for the key."""
    hashed = F.transform(split_lines(F.col("text")), lambda x: let(line_key(x), lambda k: F.when(
        F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.hash(F.lit(7), k).alias("h2")))))
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_hash"), F.posexplode(hashed).alias("pos", "h"))
            .filter("h IS NOT NULL").select("h.h1", "h.h2", "id", "text_hash", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, n_dropped, keep_runs) of every document that loses lines.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all
    its lines except in the largest id holding it. ``keep_runs`` is the document's keep bitmap in
    run lengths: the number of kept lines before each dropped one; what follows the last dropped
    line is kept. Rows with the same id count as one document, but where their texts differ each text has
    its own bitmap; a null id sorts before all others
    and its rows lose nothing (no row to give them back to).
    """
    lines = stage(long_lines(docs.filter(F.col(id_col).isNotNull()), id_col, min_chars), "line-hashes")
    shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS))
    ranged = lines.drop("text_hash").withColumn("shard", shard).repartitionByRange("h1", "h2", "shard")
    order = Window.partitionBy("h1", "h2", "shard").orderBy(F.desc("id"), "pos")
    firsts = ranged.withColumn("above", F.lag("id").over(order)).filter("above IS NULL OR above != id")
    frequent = (firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
                .filter(F.col("n") >= min_docs))
    lost = lines.join(frequent, ["h1", "h2"]).filter("id < keeper")
    dropped = lost.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    gaps = F.transform("dropped", lambda p, i: p - F.when(i > 0, F.get(F.col("dropped"), i - 1)).otherwise(-1) - 1)
    return dropped.select("id", "text_hash", F.size("dropped").cast("long").alias("n_dropped"), gaps.alias("keep_runs"))


def apply_runs(lines: Column, runs: Column) -> Column:
    """Lines kept by a bitmap in run lengths."""
    def cut(all_lines):
        starts = F.aggregate(  # 1-based start of every kept run, the open last one included
            runs, F.array(F.lit(1)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r + 1)))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda a, i: F.slice(
            all_lines, a, F.coalesce(F.get(runs, i), F.greatest(F.lit(0), F.size(all_lines) - a + 1))))))
    return F.when(runs.isNull(), lines).otherwise(let(lines, cut))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", carry: list[str] = (), **limits) -> DataFrame:
    """Id, text and carried columns of ``docs`` with ``kept`` (array of kept lines), ``n_lines`` and
    ``n_dropped``.

    The text side is not sorted: the bitmaps build the hash table of a shuffled hash join."""
    marks = keep_bitmaps(docs, id_col, **limits).withColumnsRenamed({"id": "_id", "text_hash": "_text_hash"})
    own = (F.col(id_col) == F.col("_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    return (docs.select(id_col, "text", *carry).join(marks.hint("shuffle_hash"), own, "left")
            .withColumn("_lines", split_lines(F.col("text")))
            .withColumn("kept", apply_runs(F.col("_lines"), F.col("keep_runs")))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)))
            .drop("_id", "_text_hash", "_lines", "keep_runs"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: line counts and the sha256 of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id < keeper AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(lost, false)), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
