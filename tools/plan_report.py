"""Audit the physical plan of every catalogue query.

Counts shuffles, broadcasts, windows, single-partition exchanges, Python
evaluation and nested-loop / cartesian joins in the (pre-AQE) physical plan.

usage: python tools/plan_report.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.registry import queries  # noqa: E402
from quire.session import get_session  # noqa: E402

PATTERNS = {
    "shuffle": r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)",
    "single": r"Exchange SinglePartition",
    "bcast": r"BroadcastExchange",
    "window": r"\bWindow(GroupLimit)?\b",
    "python": r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow|PythonUDF)",
    "nlj": r"(BroadcastNestedLoopJoin|CartesianProduct)",
    "scan": r"FileScan parquet",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def report(name: str, df) -> dict:
    txt = plan_text(df)
    out = {k: len(re.findall(p, txt)) for k, p in PATTERNS.items()}
    out["name"] = name
    return out


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": tempfile.mkdtemp()})
    qs = queries()
    print(f"{'query':32s} " + " ".join(f"{k:>7s}" for k in PATTERNS))
    for n in sorted(qs):
        if only and n not in only:
            continue
        r = report(n, qs[n](spark, sf_dir))
        print(f"{n:32s} " + " ".join(f"{r[k]:7d}" for k in PATTERNS))


if __name__ == "__main__":
    main(sys.argv[1:])
