"""Compare a Spark result with DuckDB on the same Parquet tables."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple], dict[str, str]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    return [columns[i] for i in order], rows, kinds


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "float": "FLOAT",
}


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences as text; empty when names, types and every value agree."""
    names, got = rows_of_spark(df)
    sql_names, want, kinds = rows_of_sql(con, sql)
    if names != sql_names:
        return [f"columns {names} != {sql_names}"]
    problems = [
        f"type of {n}: {t} != {kinds[n]}" for n, t in df.dtypes if SAME_TYPE.get(t, t).lower() != kinds[n].lower()
    ]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        problems.append(f"{len(bad)} of {len(got)} rows differ; first: {dict(zip(names, zip(*bad[0])))}")
    return problems
