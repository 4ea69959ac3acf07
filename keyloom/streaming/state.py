"""Keyed state with the semantics of a state backend's API, over the handles of a stateful processor.

Value: get() is None when absent, update(None) clears. List: no None, neither as list nor as element;
update([]) clears, add_all([]) does nothing. Map: None values are kept and contained; put_all(None) does
nothing. Reducing and aggregating state refuse None. add_and_get counts from 0. With a time to live a value goes that
long after it was last written or, with read_refreshes, last read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.streaming import StatefulProcessorHandle


class Value:
    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str, ttl_ms: int | None = None, read_refreshes: bool = False):
        self._state = handle.getValueState(name, f"value {kind}", ttl_ms) if ttl_ms else handle.getValueState(name, f"value {kind}")
        self._refreshes = read_refreshes

    def get(self) -> Any:
        if not self._state.exists():
            return None
        value = self._state.get()[0]
        if self._refreshes:
            self._state.update((value,))
        return value

    def update(self, value: Any) -> None:
        self._state.clear() if value is None else self._state.update((value,))

    def clear(self) -> None:
        self._state.clear()

    def add_and_get(self, delta: int) -> int:
        value = (self.get() or 0) + delta
        self._state.update((value,))
        return value


class List:
    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        self._state = handle.getListState(name, f"value {kind}")

    def get(self) -> list:
        return [v[0] for v in self._state.get()] if self._state.exists() else []

    def add(self, value: Any) -> None:
        self._state.appendValue((_some(value),))

    def add_all(self, values: list) -> None:
        rows = [(_some(v),) for v in _some(values)]
        if rows:
            self._state.appendList(rows)

    def update(self, values: list) -> None:
        rows = [(_some(v),) for v in _some(values)]
        self._state.put(rows) if rows else self._state.clear()

    def clear(self) -> None:
        self._state.clear()


class Map:
    def __init__(self, handle: StatefulProcessorHandle, name: str, key_kind: str, kind: str, ttl_ms: int | None = None, read_refreshes: bool = False):
        args = (name, f"key {key_kind}", f"value {kind}")
        self._state = handle.getMapState(*args, ttl_ms) if ttl_ms else handle.getMapState(*args)
        self._refreshes = read_refreshes

    def get(self, key: Any) -> Any:
        if not self._state.containsKey((key,)):
            return None
        value = self._state.getValue((key,))[0]
        if self._refreshes:
            self._state.updateValue((key,), (value,))
        return value

    def put(self, key: Any, value: Any) -> None:
        self._state.updateValue((key,), (value,))

    def put_all(self, entries: dict | None) -> None:
        for k, v in (entries or {}).items():
            self.put(k, v)

    def contains(self, key: Any) -> bool:
        return self._state.containsKey((key,))

    def remove(self, key: Any) -> None:
        self._state.removeKey((key,))

    def entries(self) -> Iterator[tuple]:
        return ((k[0], v[0]) for k, v in self._state.iterator())

    def keys(self) -> Iterator:
        return (k[0] for k in self._state.keys())

    def values(self) -> Iterator:
        return (v[0] for v in self._state.values())

    def is_empty(self) -> bool:
        return not self._state.exists()

    def clear(self) -> None:
        self._state.clear()

    def add_and_get(self, key: Any, delta: int) -> int:
        value = (self.get(key) or 0) + delta
        self.put(key, value)
        return value

    def add_sequential(self, start: int, count: int, modulo: int, delta: int) -> int:
        """Add delta to count adjacent keys (modulo modulo); the sum of their new values."""
        return sum(self.add_and_get((start + i) % modulo, delta) for i in range(count))

    def sum_sequential(self, start: int, count: int, modulo: int) -> int:
        return sum(self.get((start + i) % modulo) or 0 for i in range(count))


class Reducing:
    """Holds one value; add() folds into it."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str, reduce: Callable[[Any, Any], Any]):
        self._value, self._reduce = Value(handle, name, kind), reduce

    def get(self) -> Any:
        return self._value.get()

    def add(self, value: Any) -> None:
        now = self._value.get()
        self._value.update(_some(value) if now is None else self._reduce(now, _some(value)))

    def merge(self, other: Reducing) -> None:
        if other.get() is not None:
            self.add(other.get())
            other.clear()

    def clear(self) -> None:
        self._value.clear()


class Aggregating:
    """Holds an accumulator; add() folds a value into it, get() is its result (None when nothing was added)."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str, create: Callable[[], Any], add: Callable[[Any, Any], Any], result: Callable[[Any], Any]):
        self._value, self._create, self._add, self._result = Value(handle, name, kind), create, add, result

    def get(self) -> Any:
        now = self._value.get()
        return None if now is None else self._result(now)

    def add(self, value: Any) -> None:
        now = self._value.get()
        self._value.update(self._add(self._create() if now is None else now, _some(value)))

    def clear(self) -> None:
        self._value.clear()


def _some(value: Any) -> Any:
    if value is None:
        raise ValueError("null is not allowed in this state")
    return value
