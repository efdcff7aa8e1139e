"""Run registered queries and their SQL side by side and compare all values.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return repr(value + 0.0) if value != 0 else "0.0"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else a short description of the difference."""
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    names = [d[0] for d in con.description]
    right_cols, right = rows_of(names, con.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; {left[:1]} / {right[:1]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}" if bad else ""


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from panelloom.registry import load
    from panelloom.session import local_session, release

    queries, oracles = load()
    names = argv[2:] or list(queries)
    spark = local_session()
    con = connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "equal"
            else:
                n = len(df.collect())
                problem, note = ("" if n else "no rows"), f"rows only ({n})"
        except Exception as e:  # report and go on with the next query
            problem, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.1f}s {problem or note}", flush=True)
        if problem:
            failed.append(name)
        release(spark)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
