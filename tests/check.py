"""Compare every named query with its SQL counterpart: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = sql_rows(sql, sf_dir)
    theirs = normal(columns, rows)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if mine != theirs:
        left, right = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return f"{len(mine)} rows vs {len(theirs)}; only here {left}; only there {right}; columns {sorted(columns)}"
    return None if mine else "no rows"


if __name__ == "__main__":
    from framelake.plans import catalog, oracles
    from framelake.session import local_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session(8)
    all_queries, all_sql = catalog.queries(), oracles.oracles()
    wrong = [k for k in set(all_queries) ^ set(all_sql)]
    for key in sys.argv[2:] or all_queries:
        began = time.time()
        try:
            problem = compare(session, all_queries[key], all_sql[key], where)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {key} {time.time() - began:.1f}s {problem or ''}", flush=True)
        if problem:
            wrong.append(key)
    print("wrong:", wrong)
    sys.exit(bool(wrong))
