"""Runs a query in both engines and compares names, rows and values."""

import decimal
import math
import os
from glob import glob

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, query, sql):
    df = query(spark, SF_DIR)
    with duckdb.connect() as con:
        for f in glob(f"{SF_DIR}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        expected = rows(names, cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == expected
