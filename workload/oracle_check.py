"""Compare registered queries with their SQL: ``python -m workload.oracle_check [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description."""
    df = fn(spark, sf_dir)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    their_names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != their_names:
        return f"columns {names} != {their_names}"
    if mine != theirs:
        odd = [(x, y) for x, y in zip(mine, theirs) if x != y][:3]
        return f"{len(mine)} rows vs {len(theirs)}; first differences {odd}"
    kinds = {tuple(type(v).__name__ for v in r) for r in mine} ^ {tuple(type(v).__name__ for v in r) for r in theirs}
    return f"value types differ: {kinds}" if kinds else None


def main(names: list[str]) -> int:
    from tests.session import local_session

    from . import ORACLE, QUERIES

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        begin = time.time()
        try:
            if name in ORACLE:
                problem = compare(spark, con, fn, ORACLE[name], sf_dir)
            else:
                problem = f"no SQL; {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001 - a report of all failures is wanted
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None and name in ORACLE
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
