"""Compare a registered query with its SQL twin, as multisets of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def sql_rows(con, sql: str) -> Counter:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
