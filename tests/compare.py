"""Rows of a Spark and a DuckDB result in one form: column names, then sorted rows; floats as they are."""

import math


def plain(x):
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float) and math.isnan(x):
        return None
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    rel = con.execute(sql)
    return rows([c[0] for c in rel.description], rel.fetchall())
