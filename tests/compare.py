"""Order-free comparison of a Spark result with DuckDB's."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def expected(con, sql):
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def actual(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
