"""Run registered queries and their SQL checks side by side: `python check_oracle.py [sf_dir] [name ...]`."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from gapline.session import local_session
from gapline.suite import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """A value as text that both engines share."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, q, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if q.sql is None:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f}s"
    cur = con.execute(q.sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return False, f"{len(got[1])} vs {len(want[1])} rows; only spark {len(a)} {sorted(a)[:2]}; only sql {len(b)} {sorted(b)[:2]}"
    return True, f"{len(got[1])} rows, {took:.1f}s"


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session("check"), oracle(sf_dir)
    bad = []
    for name, q in all_queries().items():
        if args[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args[1:]):
            continue
        try:
            ok, note = compare(spark, con, q, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
