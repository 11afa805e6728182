"""Run all registered queries against their SQL: python tests/run_oracle.py [sf] [names...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from passagebook import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = local_session(8)
con = connect(sf)
bad = 0
sqls = entry.oracle_sql()
for name, query in entry.queries().items():
    if only and name not in only:
        continue
    began = time.time()
    try:
        if name in sqls:
            problems, n = compare(spark, con, query, sqls[name], sf)
        else:
            table = query(spark, sf).toArrow()
            problems, n = ["no SQL"], table.num_rows
            print(table.to_pylist()[:3])
    except Exception as exc:  # noqa: BLE001
        problems, n = [f"{type(exc).__name__}: {str(exc)[:1500]}"], -1
    bad += bool(problems) and problems != ["no SQL"]
    print(f"{name:28s} {n:8d} rows {time.time() - began:6.1f}s  {'ok' if not problems else problems}", flush=True)
print("FAILED" if bad else "ALL OK", bad)
