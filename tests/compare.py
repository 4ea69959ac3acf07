"""Compares a query's rows with those of its oracle SQL in DuckDB: names, types and values, in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame


def oracle_rows(sql: str, sf_dir: str) -> pa.Table:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con.sql(sql).to_arrow_table()


def kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp" + ("" if t.tz is None else " with zone")
    return {"large_string": "string", "string_view": "string"}.get(str(t), str(t))


def rows_of(table: pa.Table) -> Counter:
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return Counter(tuple(map(value, row.values())) for row in table.select(sorted(table.column_names)).to_pylist())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> int:
    """The number of rows, which are the same."""
    got, want = df.toArrow(), oracle_rows(sql, sf_dir)
    assert {f.name: kind(f.type) for f in got.schema} == {f.name: kind(f.type) for f in want.schema}
    a, b = rows_of(got), rows_of(want)
    assert got.num_rows == want.num_rows and a == b, f"only in Spark {list((a - b).items())[:3]}, only in the oracle {list((b - a).items())[:3]}"
    return got.num_rows
