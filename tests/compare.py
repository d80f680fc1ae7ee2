"""Rows of a Spark result and of SQL on the same files, in one form."""

import datetime
import decimal
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


def both(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(df.columns), sorted(names), got, rows(names, cur.fetchall())
