"""Rows of a query against rows of DuckDB SQL on the same Parquet tables."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float):
        return f"{x:.9g}"
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, sf_dir=SF):
    with duckdb.connect() as con:
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
