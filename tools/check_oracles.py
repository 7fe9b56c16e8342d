"""Compare registered queries with their SQL counterparts on one data folder.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dielens.plans.catalog import ORACLES, QUERIES
from dielens.plans.compare import differences, oracle_connection
from dielens.session import session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, connection, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem = str(error)[:1500] or traceback.format_exc()[-1500:]
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {took:6.2f}s", flush=True)
        if problem:
            failed.append(name)
            print("     " + problem.replace("\n", "\n     "), flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
