"""Compares a query with its SQL on a folder of tables."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def both(spark, folder, query, sql):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, str(folder))
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    at = [x[0] for x in cur.description]
    assert sorted(at) == names
    return mine, sorted(tuple(_plain(r[at.index(c)]) for c in names) for r in cur.fetchall())
