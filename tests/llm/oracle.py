"""A query's rows against those of its SQL in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda r: str([plain(r[c]) for c in sorted(names)])
    want, got = sorted(map(key, want)), sorted(map(key, got))
    assert len(want) == len(got), (len(want), len(got))
    assert want == got, next((w, g) for w, g in zip(want, got, strict=True) if w != g)
    return len(got)
