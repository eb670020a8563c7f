"""Compare a registered query with its SQL: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, dtype in df.dtypes:
        if _TYPES.get(dtype, dtype) != types[name]:
            out.append(f"type of {name}: {dtype} != {types[name]}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        out.append(f"{len(got)} rows != {len(expected)}")
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return out
