"""A corpus pipeline over the training-data operators: STAGES, run() and its SQL form.

Every stage takes the documents that its predecessor kept, and all but the last return documents
with the columns they came with (texts changed where a stage changes texts). Whatever columns there
are besides doc_id, text, lang and source travel in one struct, so their names cannot clash with an
operator's. Rows that share a doc_id and the text are copies of one document; rows that share only one
of the two, or have no doc_id, are told apart by their texts and ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, language, line_dedup, mixing, packing
from quire.llm.common import release, stage

MIN_LANGUAGE_SCORE = 0.5
BATCH_BYTES = 4 << 20  # of an Arrow batch of texts, one row at least
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BOX = "__document__"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` between tasks and their Python workers, unless the session has smaller
    ones. Spark's 10,000 rows are tens of MB of texts, held several times over by every task: while the batch
    is filled, while it is sent, and in the worker. Rows are the same in batches of any size."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def boxed(docs: DataFrame) -> DataFrame:
    """(text, row, BOX): the text, an id of the row, and all other columns in a struct. A row without
    doc_id gets an id above 2^62 from its text."""
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    row = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    return docs.select("text", row.alias("row"), other.alias(BOX))


def unboxed(rows: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    was = {c: F.col("text") if c == "text" else F.col(BOX)[c] for c in docs.columns}
    return rows.select(*[(changed or {}).get(c, was[c]).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half; texts that are null or
    without letters go. The model learns from the labelled documents among those at hand."""
    small_batches(spark)
    model = language.train(docs.select("doc_id", "text", "lang"))
    found = language.predict(boxed(docs), model, ["text", BOX])
    return unboxed(found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that other documents repeat; n_chars follows the text. A
    document that loses nothing keeps its text as it is."""
    rows = line_dedup.dedup_lines(boxed(docs), "row", carry=[BOX])
    lost, kept = F.col("n_dropped") > 0, F.array_join("kept", "\n")
    changed = {"text": F.when(lost, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length(kept).cast("long")).otherwise(F.col(BOX)["n_chars"])
    return unboxed(rows, docs, changed)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    release(spark)  # what the stages before shuffled is not needed any more
    rows = boxed(docs).withColumn("key", F.xxhash64("row", "text"))
    names = rows.select("key", "row").distinct()
    groups = stage(jaccard.jaccard_components(rows, "key").select(F.col("key").alias("_key"), "component_id").distinct()
                   .join(names, F.col("_key") == F.col("key")).select("key", "row", "component_id"), "near-groups")
    if groups.groupBy("key").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two documents share a 64-bit name")
    release(spark)  # the links' shuffle files are not needed when the texts move
    firsts = groups.groupBy("component_id").agg(F.min_by("key", F.struct("row", "key")).alias("key")).select("key")
    return unboxed(rows.join(firsts, "key", "left_semi").dropDuplicates(["key"]), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, documents as often as it takes them."""
    rows = boxed(docs).withColumn("source", F.col(BOX)["source"])
    return unboxed(mixing.mix_documents(rows, "row"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 4096 ids; a repeated document is packed as
    often as it is there."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# the language model is learned and the tokenizer is a library, so SQL cannot express the result
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table ``documents``, each to what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
