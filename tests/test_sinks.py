"""Sinks: materialise (view, parquet, checkpoint, append) and append_rows."""

from pyspark.sql import functions as F

from quire.sources.sinks import append_rows, materialize


def test_materialize_forms(spark, tmp_path):
    df = spark.range(10).withColumn("g", (F.col("id") % 3).cast("int"))
    assert materialize(df, "t_view", how="view").count() == 10
    assert materialize(df, "t_ckpt", how="checkpoint").count() == 10
    out = materialize(df, "t_parq", partition_by=["g"])
    assert sorted(r.id for r in out.collect()) == list(range(10))


def test_append_query_result(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.range(3).select(F.col("id").alias("x"))
    materialize(first, "ledger", path=path)
    more = spark.range(3, 5).select(F.col("id").alias("x"))
    both = materialize(more, "ledger", path=path, mode="append")
    assert sorted(r.x for r in both.collect()) == [0, 1, 2, 3, 4]


def test_append_rows_casts_to_base_schema(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([("b", 2)], "v string, k long")
    out = append_rows(base, new)
    assert out.schema == base.schema and sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "b")]
