"""Rows of Spark and of DuckDB, made comparable."""

import datetime
import decimal
import math


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) and abs(x) < 1e15 else round(x, 6)
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(value, x))
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    got = con.execute(sql)
    return table([d[0] for d in got.description], got.fetchall())
