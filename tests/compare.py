"""Rows of a Spark query against rows of DuckDB SQL on the same folder."""

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{round(float(value), 6) + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    found = con.sql(sql)
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} against {sorted(found.columns)}"
    kinds = dict(df.dtypes)
    odd = [c for c, t in zip(found.columns, map(str, found.types), strict=True) if ("INT" in t) != (kinds[c] in ("int", "bigint", "smallint", "tinyint")) or ("DOUBLE" in t or "DECIMAL" in t) != (kinds[c] in ("double", "float") or kinds[c].startswith("decimal")) or "HUGEINT" in t or "DECIMAL" in t]
    a, b = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    if a != b:
        diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} rows against {len(b)}: {diff}"
    return f"kinds of {odd}: {[kinds[c] for c in odd]}" if odd else ""
