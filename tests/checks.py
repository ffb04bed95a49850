"""Comparing a query's rows with those of its SQL, as sorted text."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows with columns in name order, every value as text, in sorted order."""
    frame = frame.reindex(sorted(frame.columns), axis=1)
    columns = []
    for name in frame.columns:
        values = frame[name]
        if pd.api.types.is_datetime64_any_dtype(values):
            columns.append(values.astype("datetime64[us]").astype(str).tolist())
        else:
            columns.append(["-" if pd.isna(v) else _text(v) for v in values])
    return sorted(zip(*columns))


def _text(value) -> str:
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)
