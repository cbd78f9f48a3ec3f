"""Development helper: `python -m tests.llm.run_query NAME [sf_dir]` compares one query with its SQL check."""

import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from gapline.session import local_session


def compare(spark, name, sf_dir):
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if not sql:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f}s, first {got[1][:2]}"
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows equal, {took:.1f}s"
    a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, f"{got[0]} {want[0]} {len(got[1])} vs {len(want[1])}; spark {sorted(a)[:3]}; sql {sorted(b)[:3]}"


if __name__ == "__main__":
    session = local_session("run_query")
    for n in sys.argv[1].split(","):
        print(n, *compare(session, n, sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"))
