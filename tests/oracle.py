"""Runs a query on Spark and its SQL on DuckDB and compares the bags of rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v


def bag(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str = SF) -> int:
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    mine = bag(found.select(*names).collect())
    con = connection(sf_dir)
    con.execute(f"CREATE TEMP TABLE answer AS {sql}")
    there = [r[0] for r in con.execute("SELECT column_name FROM information_schema.columns WHERE table_name = 'answer'").fetchall()]
    assert sorted(there) == names, (sorted(there), names)
    theirs = bag(con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + " FROM answer").fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (names, a, b)
    return len(mine)
