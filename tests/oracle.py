"""Compares a query with its SQL in DuckDB, rows in any order, floats at seven digits."""

import decimal
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float | np.floating):
        return "nan" if v != v else "%.7g" % v if abs(v) > 1e-9 else "0"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
