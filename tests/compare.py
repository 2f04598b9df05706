"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark_df, con, sql):
    """None when equal, else a text that says what differs."""
    a_cols, a = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b_cols, b = _rows([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}"
    types = {d[0]: str(d[1]) for d in cur.description}
    for f in spark_df.schema.fields:
        want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}.get(f.dataType.simpleString(), "?")
        if types[f.name] != want:
            return f"type of {f.name}: {want} / {types[f.name]}"
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows; first: {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; first: {bad[0]}"
    return None


def main():
    import __spark_entry__ as e
    from scalarlake.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    con = duck(sf_dir)
    qs, sql = e.queries(), e.oracle_sql()
    names = sys.argv[1:] or list(qs)
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            res = difference(df, con, sql[n]) if n in sql else f"rows only: {df.count()}"
        except Exception as ex:
            res = f"{type(ex).__name__}: {str(ex)[:600]}"
        failed += bool(res) and n in sql
        print(f"{n:24s} {time.time() - t:6.2f}s {res or 'ok'}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
