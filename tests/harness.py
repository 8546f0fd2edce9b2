"""Compare a query with its SQL twin, row by row."""

from __future__ import annotations

import math

import duckdb

from lorescope.sources.tables import TABLES

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, folder: str) -> str:
    """'' when names, simple types and all values agree, else what differs."""
    con = duck(folder)
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    theirs = dict(zip(names, types))
    off = [(f.name, f.dataType.simpleString(), theirs[f.name]) for f in df.schema
           if f.dataType.simpleString() in _TYPES and _TYPES[f.dataType.simpleString()] != theirs[f.name]]
    if off:
        return f"types {off}"
    want = _rows(rel.fetchall(), names)
    got = _rows(df.collect(), df.columns)
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ ({sorted(df.columns)}), e.g. {bad[0]}"
    if not want:
        return "no rows"
    return ""
