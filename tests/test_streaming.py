"""The streaming visit summary equals the batch one for any files in any order."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators.funnel import visit_summary
from quire.sources.views import Views
from quire.streaming.visits import compact, read_summary, run_visit_summary

from conftest import SMALL_SF


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def files(spark, tmp_path, conditions):
    """One event file per condition, written and dated in the order given."""
    ev, src = Views(spark, SMALL_SF).t.events, tmp_path / "src"
    src.mkdir()
    for i, cond in enumerate(conditions):
        part = tmp_path / f"part{i}"
        ev.where(cond).coalesce(1).write.parquet(str(part))
        f = next(p for p in os.listdir(part) if p.endswith(".parquet"))
        os.link(part / f, src / f"events_{i}.parquet")
        os.utime(src / f"events_{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return str(src)


@pytest.mark.parametrize("per_batch", [None, 1])
def test_newer_days_first_equals_batch(spark, tmp_path, per_batch):
    """Files whose events are weeks older than those already read change nothing but the order."""
    v = Views(spark, SMALL_SF)
    first, last = v.t.events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2).cast("timestamp_ntz")
    src = files(spark, tmp_path, [F.col("ts") >= middle, (F.col("ts") < middle) & (F.col("event_id") % 2 == 0),
                                  (F.col("ts") < middle) & (F.col("event_id") % 2 == 1)])
    got = run_visit_summary(spark, src, v.v_campaign, out_dir=str(tmp_path / "out"), glob="events_*.parquet",
                            max_files_per_trigger=per_batch)
    exp = visit_summary(v.v_event, v.v_campaign)
    assert same(got, exp)
    log = str(tmp_path / "out" / "changelog")
    assert spark.read.parquet(log).select("batch_id").distinct().count() == (3 if per_batch else 1)
    compact(spark, log, str(tmp_path / "merged"))
    assert same(read_summary(spark, str(tmp_path / "merged"), v.v_campaign), exp)


def test_a_dataset_that_is_a_folder(spark, tmp_path):
    v = Views(spark, SMALL_SF)
    folder = str(tmp_path / "events.parquet")
    v.t.events.repartition(3).write.parquet(folder)
    assert same(run_visit_summary(spark, folder, v.v_campaign, out_dir=str(tmp_path / "out")),
                visit_summary(v.v_event, v.v_campaign))
