"""Rows of a Spark query and of its DuckDB SQL, in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def form(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(form(r[c]) for c in cols) for r in df.collect())


def duckdb_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(tuple(form(x[i]) for i in at) for x in r.fetchall())
