"""Row patterns per key: variables with quantifiers, greedy, with conditions over what is bound so far.

Rows are dealt by key and stream through a task in order; of a key's rows those are held that an open match spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Row = dict[str, Any]


class Rows(list):
    """The rows bound to a variable; total() of a column costs a step a row, however often it is asked for."""

    def __init__(self) -> None:
        super().__init__()
        self._totals: dict[str, Any] = {}

    def total(self, column: str) -> Any:
        if column not in self._totals:
            self._totals[column] = sum(r[column] for r in self)
        return self._totals[column]

    def append(self, row: Row) -> None:
        super().append(row)
        for c in self._totals:
            self._totals[c] += row[c]

    def pop(self) -> Row:
        row = super().pop()
        for c in self._totals:
            self._totals[c] -= row[c]
        return row


Bound = dict[str, Rows]


@dataclass(frozen=True)
class Pattern:
    """variables: (name, quantifier) with '', '+' or '*'. define: a variable's condition, given the row and
    what is bound, the row already among it; without one any row fits. within: longest time from first to
    last row, exclusive, in the units of the order column. skip: 'past_last', 'next_row', 'to_last NAME' or
    'to_first NAME'. measures: what a match emits.
    """

    variables: tuple[tuple[str, str], ...]
    measures: Callable[[Bound], tuple]
    define: dict[str, Callable[[Row, Bound], bool]] = field(default_factory=dict)
    skip: str = "past_last"
    within: Any = None


class Open(Exception):
    """What a match is depends on rows after those at hand."""


def match_at(rows: list[Row], at: int, pattern: Pattern, order: str, ended: bool = True) -> tuple[Bound, dict[str, list[int]], int] | None:
    """The greedy match that starts at a row: bindings, their places and the place after it. Raises Open if it would look
    beyond the rows and these haven't ended."""
    bound: Bound = {n: Rows() for n, _ in pattern.variables}
    places: dict[str, list[int]] = {n: [] for n, _ in pattern.variables}

    def take(k: int, place: int) -> bool:
        name = pattern.variables[k][0]
        if place >= len(rows):
            if not ended:
                raise Open
            return False
        row = rows[place]
        if pattern.within is not None and row[order] - rows[at][order] >= pattern.within:
            return False
        bound[name].append(row)
        condition = pattern.define.get(name)
        if condition is not None and not condition(row, bound):
            bound[name].pop()
            return False
        places[name].append(place)
        return True

    # (variable, place) to try next; what was chosen before can be given back one row at a time.
    k, place = 0, at
    choices: list[int] = []  # variable of every taken row
    last = len(pattern.variables)
    while k < last:
        quantifier = pattern.variables[k][1]
        if take(k, place):
            choices.append(k)
            place += 1
            if quantifier == "":
                k += 1
            continue
        enough = quantifier == "*" or (quantifier == "+" and bool(places[pattern.variables[k][0]]))
        if enough:
            k += 1
            continue
        # Back up: give back the last row of a repeated variable and go on after it.
        while choices:
            j = choices.pop()
            name = pattern.variables[j][0]
            bound[name].pop()
            places[name].pop()
            place -= 1
            if pattern.variables[j][1] == "*" or (pattern.variables[j][1] == "+" and places[name]):
                k = j + 1
                break
        else:
            return None
    return bound, places, place


def matches(rows: list[Row], pattern: Pattern, order: str, ended: bool = True) -> Iterator[tuple]:
    """Measures of the matches among one key's ordered rows. What is done with goes from rows; if they haven't ended,
    those stay that matches to come may need."""
    at = 0
    while at < len(rows):
        try:
            found = match_at(rows, at, pattern, order, ended)
        except Open:
            break
        if found is None:
            at += 1
            continue
        bound, places, end = found
        yield pattern.measures(bound)
        mode, _, name = pattern.skip.partition(" ")
        if mode == "past_last":
            at = max(end, at + 1)
        elif mode == "next_row":
            at += 1
        else:
            to = (places[name] or [at])[-1 if mode == "to_last" else 0]
            at = max(to, at + 1)
    del rows[:at]


def match_recognize(df: DataFrame, keys: list[str], order: str, pattern: Pattern, schema: T.StructType, ties: list[str] | None = None) -> DataFrame:
    """keys and measures of every match; schema names the measures. ties orders rows of equal order."""
    out = T.StructType([df.schema[k] for k in keys] + list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        key, rows = None, []

        def emitted(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(arrow)], names=arrow.names)

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    found += [(*key, *m) for m in matches(rows, pattern, order)] if rows else []
                    key, rows = own, []
                rows.append(row)
            found += [(*key, *m) for m in matches(rows, pattern, order, False)]
            yield emitted(found)
        if rows:
            yield emitted([(*key, *m) for m in matches(rows, pattern, order)])

    return df.repartition(*keys).sortWithinPartitions(*keys, order, *(ties or [])).mapInArrow(run, out)
