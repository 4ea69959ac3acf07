"""Slow lookups: a function that waits for an outside service, called for many rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def looked_up(df: DataFrame, column: str, answer: Callable[[Any], Any], name: str, kind: T.DataType, at_once: int = 32) -> DataFrame:
    """df with name: answer(column) for every row, in order, with up to at_once calls of a task under way.

    A call that fails fails the task, which Spark runs again; equal values of a batch are asked for once.
    """
    schema = T.StructType([*[f for f in df.schema if f.name.lower() != name.lower()], T.StructField(name, kind)])
    kept = [f.name for f in schema][:-1]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                values = b.column(b.schema.get_field_index("__asked")).to_pylist()
                asked = list(dict.fromkeys(values))
                answers = dict(zip(asked, pool.map(answer, asked), strict=True))
                new = pa.array([answers[v] for v in values], arrow.field(len(kept)).type)
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], new], names=arrow.names)

    return df.select(*kept, df[column].alias("__asked")).mapInArrow(run, schema)
