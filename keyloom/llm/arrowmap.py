"""Row-preserving Arrow maps: every input row keeps its columns and gains computed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once by a kernel; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its len+1 offsets from 0; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1] if ends else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text stays under limit bytes (one row at least)."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def with_arrow_columns(df: DataFrame, text: str, added: T.StructType, kernel: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) plus the added ones that kernel computes for each slice of rows.

    An input column named like an added one (in any case) is replaced by it. The kernel returns one
    Arrow array per added field, in order, as long as its slice.
    """
    names = {f.name.lower() for f in added}
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = text if text in passed else "__text"
    frame = df.select(*[df[f"`{c}`"] for c in passed], *([] if text in passed else [df[f"`{text}`"].alias(source)]))
    schema = T.StructType([frame.schema[c] for c in passed] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                new = kernel(part.column(part.schema.get_field_index(source)))
                old = [part.column(part.schema.get_field_index(c)) for c in passed]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip([*old, *new], arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return frame.mapInArrow(run, schema)
