"""Compare queries with their SQL twins: check_oracles.py [sf_dir] [name …]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, rows = compare(spark, connection, sf_dir, function, oracles[name])
            else:
                problem, rows = None, function(spark, sf_dir).count()
        except Exception as error:
            problem, rows = "".join(traceback.format_exception_only(error))[:1500], 0
        failed += problem is not None
        label = "FAIL" if problem else ("ok" if name in oracles else "rows only")
        print(f"{label:9} {name:32} {rows:7} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
