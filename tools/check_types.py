"""Compare column types of every catalogue query with its DuckDB oracle.

usage: python tools/check_types.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.compare import duck_connect, type_differences  # noqa: E402
from quire.plans.registry import oracle_sql, queries  # noqa: E402
from quire.session import get_session  # noqa: E402

def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = get_session("local[4]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, ors = queries(), oracle_sql()
    bad = 0
    for name in sorted(qs):
        diff = type_differences(qs[name](spark, sf_dir), con, ors[name])
        if diff:
            bad += 1
            print(f"{name:32s} {diff}")
    print(f"{bad} queries with type differences")


if __name__ == "__main__":
    main(sys.argv[1:])
