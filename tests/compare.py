"""Results of Spark and of DuckDB as comparable rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def value(x):
    if x is None or isinstance(x, (str, bytes, bool)):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    x = float(x)
    return 0.0 if x == 0 else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(value(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())
