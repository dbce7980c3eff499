"""Rows of a query and of its SQL, in one form."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def of_spark(df):
    return rows(df.columns, df.collect())


def of_duckdb(sql, folder):
    import duckdb

    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        got = db.execute(sql)
        return rows([d[0] for d in got.description], got.fetchall())
