"""Runs a query and its SQL on the same tables and compares rows, as sorted by all columns in order of their names."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.10g}") if math.isfinite(v) else str(v)
    return str(v)


def differences(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got_names = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != got_names:
        return f"columns {got_names} {sorted(names)}"
    order = [names.index(n) for n in got_names]
    key = lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", "") for x in r)
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)
    got = sorted((tuple(plain(r[n]) for n in got_names) for r in df.collect()), key=key)
    if got == want:
        return None
    extra, lost = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} {len(want)} rows; only Spark {extra}; only SQL {lost}"
