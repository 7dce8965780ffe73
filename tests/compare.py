"""Runs registered queries against DuckDB. Usage: python tests/compare.py FOLDER [NAME_PREFIX ...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else what differs; and the number of rows."""
    df = query(spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    kinds = {n: str(t).upper() for n, t in zip((d[0] for d in cursor.description), (d[1] for d in cursor.description))}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for n, kind in df.dtypes:
        if same.get(kind) != kinds[n]:
            return f"type of {n}: {kind} against {kinds[n]}", len(got)
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows against {len(want)}; missing {missing} extra {extra}"[:1500], len(got)
    return None, len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from veilframe.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, only = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    oracle, bad = oracle_sql(), 0
    for name, query in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        if name not in oracle:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, query, oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {e}"[:900], -1
        bad += problem is not None
        print(f"{name:32s} {n:8d} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("different:", bad)
