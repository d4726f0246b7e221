"""Compare a query with its SQL on the shared tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in (r[i] for i in order)) for r in values]
    return sorted(plain, key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = con.execute(sql)
    return sorted(c[0] for c in found.description), rows([c[0] for c in found.description], found.fetchall())


def result(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
