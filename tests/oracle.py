"""Runs a query and its DuckDB SQL over the same tables and compares rows, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    import datetime
    import decimal
    import math

    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else (0.0 if abs(x) < 5e-7 else float(f"{x:.9g}"))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(_plain(v) for v in x)
    return x


def both(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rel.fetchall())
    return got, want
