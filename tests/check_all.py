"""Compare every registered query with its SQL twin: check_all.py [folder] [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from roadflow import catalog  # noqa: E402
from roadflow.session import build_session  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    catalog.load()
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in catalog.SQL:
                problem, n = oracle.compare(spark, con, folder, name, fn, catalog.SQL[name])
            else:
                problem, n = None, fn(spark, folder).count()
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:45s} {n:8d} rows {time.time() - start:6.1f} s {'' if name in catalog.SQL else '(rows only)'} {problem or ''}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
