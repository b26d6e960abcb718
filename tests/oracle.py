"""Rows of a registered query beside those of its SQL twin."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 9) if math.isfinite(x) else str(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    theirs = rows_of(columns, got.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        return f"{name}: {len(mine)} and {len(theirs)} rows; first differences {[p for p in zip(mine, theirs) if p[0] != p[1]][:2]}"
    return None
