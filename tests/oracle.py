"""Spark's rows against DuckDB's, in any order."""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} against {sorted(names)}"
    if ours != theirs:
        only = [x for x in ours if x not in theirs][:2], [x for x in theirs if x not in ours][:2]
        return f"{name}: {len(ours)} against {len(theirs)} rows; {only}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tarnflow.session import session

    spark, sf = session(), "/root/testdata/sf0.01"
    con, sql = connect(sf), entry.oracle_sql()
    for name, f in entry.queries().items():
        if name in sql and (len(sys.argv) < 2 or name in sys.argv[1:]):
            try:
                print(differences(spark, con, name, f, sql[name], sf) or f"{name} ok", flush=True)
            except Exception as e:
                print(f"{name}: {type(e).__name__} {str(e)[:500]}", flush=True)
