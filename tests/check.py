"""Run queries against their SQL and print what differs: check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import connect, spark_rows, sql_rows
from sentspark.session import local_session

sf_dir, names = sys.argv[1], sys.argv[2:]
spark = local_session("8")
con = connect(sf_dir)
sql = entry.oracle_sql()
for name, fn in entry.queries().items():
    if names and name not in names:
        continue
    try:
        t = time.time()
        got = spark_rows(fn(spark, sf_dir))
        t_spark = time.time() - t
        if name not in sql:
            print(f"ROWS  {name:22} {len(got[1]):8} rows {t_spark:6.2f}s", flush=True)
            continue
        t = time.time()
        want = sql_rows(con, sql[name])
        t_sql = time.time() - t
        state = "ok" if got == want else "DIFF"
        print(f"{state:5} {name:22} {len(got[1]):8} rows {t_spark:6.2f}s sql {t_sql:5.2f}s", flush=True)
        if got != want:
            print("   ", got[0], want[0], len(got[1]), len(want[1]))
            shown = 0
            for a, b in zip(got[1], want[1]):
                if a != b and shown < 2:
                    print("    spark", repr(a)[:600], "\n    sql  ", repr(b)[:600])
                    shown += 1
    except Exception as e:
        print(f"ERR   {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
