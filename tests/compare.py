"""Rows of a DataFrame against DuckDB's, whatever their order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


def same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
