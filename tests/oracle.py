"""Runs a query and its SQL side by side: `python tests/oracle.py [--dir DIR] [NAME...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def same_order(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, name: str, sf_dir: str) -> str:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = same_order(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}"
    want = same_order(*sql_rows(sql, sf_dir))
    if got[0] != want[0]:
        return f"DIFFERENT columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
        return f"DIFFERENT {len(got[1])} {len(want[1])}\n  spark {only[0]}\n  sql   {only[1]}"
    return f"same, {len(got[1])} rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pagemill.session import local_session

    args = sys.argv[1:]
    where = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        where, args = args[1], args[2:]
    session = local_session(int(os.environ.get("CPUS", "8")))
    bad = 0
    for query in args or entry.queries():
        began = time.time()
        try:
            said = differences(session, query, where)
        except Exception as e:
            said = f"DIFFERENT error {str(e)[:1500]}"
        bad += "DIFFERENT" in said
        print(f"{query}: {said} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bad > 0)
