"""Compares a query with its SQL, run by DuckDB on the same tables."""

import math
import os


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return repr(value)


def table_of(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(normal(r[k]) for k in order) for r in data)


def connect(duckdb, folder):
    link = duckdb.connect()
    link.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        link.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return link


def same(spark, folder, link, query, text):
    df = query(spark, folder)
    result = link.execute(text)
    columns = [d[0] for d in result.description]
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(columns, result.fetchall())
