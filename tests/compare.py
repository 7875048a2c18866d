"""Order-insensitive comparison of a Spark result with DuckDB SQL over the same files."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(spark, sf_dir, query, sql, con):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(*[df[c] for c in columns]).collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)
    assert len(found) == len(wanted)
    assert found == wanted
