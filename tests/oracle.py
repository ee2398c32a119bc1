"""Holds a query against its SQL in DuckDB: column names, row count and values, columns sorted by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    with duckdb.connect() as db:
        for p in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = db.execute(sql)
        names, want = [x[0] for x in found.description], found.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, want)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
