"""Show how a key holding a third of all rows is spread by the ordered scan.

Moves a third of the subscription rows onto one customer, then reports the largest and the
median partition (rows) of a window over that key and of the windows that ``sequence`` opens
per (key, range), in the order of the event id, which is unique.

usage: python tools/skew_demo.py [sf_dir] [partitions]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quire.operators.sequence import sequence  # noqa: E402
from quire.session import get_session  # noqa: E402
from quire.sources.views import Views  # noqa: E402


def sizes(df) -> list[int]:
    """Rows per task, in ascending order; the sum keeps the numbering in the plan."""
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("rn")).collect()
    return sorted(r["n"] for r in per)


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    parts = int(argv[1]) if len(argv) > 1 else 64
    spark = get_session("local[8]", shuffle_partitions=parts, extra={
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.local.dir": tempfile.mkdtemp(prefix="quire-skew-")})
    subs = Views(spark, sf_dir).v_sub
    hot = subs.withColumn("customer_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("customer_id")))
    window = hot.withColumn("rn", F.row_number().over(Window.partitionBy("customer_id").orderBy("event_id")))
    for name, df in (("window over the key", window), ("sequence", sequence(hot, ["customer_id"], ["event_id"]))):
        s = sizes(df)
        print(f"{name}: {sum(s)} rows in {len(s)} partitions, largest {s[-1]} ({s[-1] / sum(s):.1%}), median {s[len(s) // 2]}")


if __name__ == "__main__":
    main(sys.argv[1:])
