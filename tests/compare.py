"""Spark rows against DuckDB rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, str | bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime | datetime.date):
        return str(x)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kind(t: str) -> str:
    """Types the two engines call differently."""
    t = str(t).lower()
    return {"bigint": "long", "integer": "int", "hugeint": "huge", "varchar": "string"}.get(t, t)


def differences(spark, queries, oracle, name: str, sf_dir: str, c) -> str:
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = c.sql(oracle[name])
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    mine, theirs = {k: kind(t) for k, t in df.dtypes}, {k: kind(t) for k, t in zip(rel.columns, rel.types, strict=True)}
    odd = {k: (mine[k], theirs[k]) for k in mine if mine[k].replace("bigint", "long") != theirs[k]}
    want = rows(rel.columns, rel.fetchall())
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} / {len(want)} rows; Spark {a}; SQL {b}"
    return f"types {odd}" if odd else ""
