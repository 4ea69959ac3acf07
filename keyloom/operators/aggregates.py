"""User-defined aggregates in two phases: accumulators are made where the rows are, then merged per key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys whose accumulators a task holds at once; beyond, it sends what it has and starts anew.
HELD_KEYS = 100_000


@dataclass(frozen=True)
class Aggregate:
    """create() an accumulator, add(accumulator, value), merge two, and read the result. Accumulators pickle."""

    create: Callable[[], Any]
    add: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]


def reducing(reduce: Callable[[Any, Any], Any]) -> Aggregate:
    """An aggregate that folds values of one kind."""
    fold = lambda a, b: b if a is None else a if b is None else reduce(a, b)
    return Aggregate(lambda: None, fold, fold, lambda a: a)


def aggregated(df: DataFrame, keys: list[str], column: str, how: Aggregate, name: str, kind: T.DataType) -> DataFrame:
    """keys and name: how's result over the non-null values of column, for every key (a null key is a key).

    A key costs a task one row, however many rows it has there; merging streams through a task by key.
    """
    partial = T.StructType([*[df.schema[k] for k in keys], T.StructField("__accumulator", T.BinaryType())])
    final = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, kind)])

    def batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        sent = lambda: batch([(*k, pickle.dumps(a)) for k, a in held.items()], partial)
        for b in batches:
            for *key, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = held.get(tuple(key)) if tuple(key) in held else how.create()
                held[tuple(key)] = now if value is None else how.add(now, value)
            if len(held) > HELD_KEYS:
                yield sent()
                held = {}
        yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        total: Any = None
        for b in batches:
            done = []
            for *key, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(key) == current:
                    total = how.merge(total, pickle.loads(raw))
                else:
                    done += [(*current, how.result(total))] if current is not None else []
                    current, total = tuple(key), pickle.loads(raw)
            yield batch(done, final)
        if current is not None:
            yield batch([(*current, how.result(total))], final)

    parts = df.select(*keys, column).mapInArrow(gather, partial)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, final)
