"""Run every catalogue query in Spark and its DuckDB oracle; print one line per key
(rows, column names, value multiset and column types must all agree).

usage: python tools/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.compare import compare, duck_connect, type_differences  # noqa: E402
from quire.plans.registry import oracle_sql, queries  # noqa: E402
from quire.session import get_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, ors = queries(), oracle_sql()
    bad = 0
    for name in sorted(qs):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name not in ors:
                n = df.count()
                print(f"NOSQL {name:32s} rows={n} {time.time()-t0:.1f}s", flush=True)
                continue
            r = compare(name, df, con, ors[name])
            types = type_differences(df, con, ors[name])
            ok = r.ok and not types
            tag = "OK   " if ok else "FAIL "
            bad += not ok
            print(f"{tag} {name:32s} spark={r.rows_spark} oracle={r.rows_oracle} "
                  f"{time.time()-t0:.1f}s {r.detail}{' types ' + str(types) if types else ''}", flush=True)
        except Exception as e:  # report and continue
            bad += 1
            msg = str(e).strip().splitlines()[0][:300] if str(e).strip() else repr(e)
            print(f"ERROR {name:32s} {type(e).__name__}: {msg}", flush=True)
    print(f"{len([n for n in qs if not only or n in only])} keys, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
