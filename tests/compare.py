"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(timespec="microseconds")
    return repr(v) if v is None else f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty text when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    left_names = df.columns
    left = rows_of(left_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_names = [d[0] for d in cur.description]
    right = rows_of(right_names, cur.fetchall())
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} != {sorted(right_names)}"
    if not left:
        return "no rows"
    if left == right:
        return ""
    only_l = [r for r in left if r not in set(right)][:2]
    only_r = [r for r in right if r not in set(left)][:2]
    return f"rows {len(left)} vs {len(right)}\n   spark  {only_l}\n   duckdb {only_r}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pulseframe.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                msg = f"rows only: {fn(spark, sf).count()}"
            else:
                msg = compare(spark, con, name, fn, sql, sf) or "ok"
        except Exception as error:  # report and go on with the next query
            msg = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not (msg == "ok" or msg.startswith("rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {msg}", flush=True)
    print("failed:", bad)
