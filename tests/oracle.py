"""Compare a query with its SQL, without regard to row order."""

import datetime
import decimal
import os
from collections import Counter

import duckdb


def connect(root):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(root):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{root}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
