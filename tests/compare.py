"""Holds a query against its SQL on DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in at) for r in found)


def same(spark, sf_dir, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = f(spark, sf_dir)
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    got = rows(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
