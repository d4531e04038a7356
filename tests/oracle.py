"""Comparison of a Spark result with DuckDB SQL on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(spark_df, db, sql):
    cursor = db.execute(sql)
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
