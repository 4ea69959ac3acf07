"""Keyed operators whose state is no running sum: integer recurrences, with Java's wrapping 64-bit longs.

Rows stream through a task in order of key and sequence; a key's state is a few numbers (and small maps),
so memory does not grow with the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.operators.modules import COLUMNS

SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS)
_MASK = (1 << 64) - 1
# The 64-bit finaliser's shift and factor.
SHIFT, FACTOR = 33, 0xFF51AFD7ED558CCD


def signed(x: int) -> int:
    """x wrapped to a signed 64-bit number."""
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def mix(x: int) -> int:
    """One round of a 64-bit finaliser on a wrapping long."""
    x &= _MASK
    x ^= x >> SHIFT
    x = (x * FACTOR) & _MASK
    return signed(x ^ (x >> SHIFT))


def divided(a: int, b: int) -> int:
    """Integer division towards zero."""
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def string_hash(text: str) -> int:
    """The 31-polynomial over a string's UTF-16 units as a signed 32-bit number."""
    h = 0
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (31 * h + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


Step = Callable[[dict, int, int, int, int, int], tuple[int, int]]


def keyed(df: DataFrame, step: Step) -> DataFrame:
    """step(state, key, metric, aux, category, sequence) -> (metric, aux), over every key in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            metrics, auxes = [], []
            for key, metric, aux, category, sequence, _ in zip(*columns, strict=True):
                if key != current:
                    current, state = key, {}
                m, a = step(state, key, metric, aux, category, sequence)
                metrics.append(m)
                auxes.append(a)
            big = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(metrics, big), pa.array(auxes, big), *batch.columns[3:]], names=list(COLUMNS))

    ready = df.select(*[df[c].cast("bigint") for c in COLUMNS]).repartition("key").sortWithinPartitions("key", "sequence", "branch")
    return ready.mapInArrow(run, SCHEMA)


def predict(s: dict, key: int, metric: int, aux: int, category: int, sequence: int) -> tuple[int, int]:
    """Fraud score: a decaying sum of transition penalties, gaps and amounts."""
    penalty = 11 * abs(category - s.get("type", category))
    gap = abs(sequence - s.get("id", sequence)) & 31
    score = divided(signed(s.get("score", 0) * 3 + penalty + gap + metric), 2)
    s.update(type=category, id=sequence, score=score, n=s.get("n", 0) + 1)
    return score, s["n"]


def moving_average(s: dict, key: int, metric: int, aux: int, category: int, sequence: int) -> tuple[int, int]:
    """Average over at most aux values; a full window collapses to its average."""
    window = max(1, aux)
    total, n = signed(s.get("sum", 0) + metric), min(window, s.get("n", 0) + 1)
    average = divided(total, n)
    s.update(sum=average, n=1) if n >= window else s.update(sum=total, n=n)
    return average, aux


def dense_value(name: str, states: int, reducers: bool) -> Step:
    """Several value states (and a running sum and maximum) folded into a hash."""

    def step(s: dict, key: int, metric: int, aux: int, category: int, sequence: int) -> tuple[int, int]:
        hashed = mix(metric + aux + sequence + len(name))
        if reducers:
            s["sum"] = signed(s.get("sum", 0) + metric)
            s["max"] = max(s.get("max", metric + (category & 31)), metric + (category & 31))
            hashed = mix(hashed + s["sum"] + s["max"])
        for i in range(states):
            now = s.get(i, signed(hashed + i) % 4096)
            s[i] = then = signed(now + signed(hashed + metric + aux + 13 * i) % 127 + 1)
            hashed = mix(hashed + now + then + 17 * i)
        return hashed, aux

    return step


def dense_map(name: str, values: int, maps: int, width: int, stride: int) -> Step:
    """Value states and maps of a fixed width, slots of which are dropped at a stride."""
    width, stride, seed = max(4, width), max(2, stride), string_hash(name)

    def step(s: dict, key: int, metric: int, aux: int, category: int, sequence: int) -> tuple[int, int]:
        hashed = mix(metric + aux + sequence + seed)
        for i in range(values):
            now = s.get(i, signed(hashed + i) % 2048)
            s[i] = then = signed(now + signed(hashed + metric + 19 * i) % 71 + 1)
            hashed = mix(hashed + now + then + aux)
        for i in range(maps):
            held = s.setdefault(("map", i), {})
            slot = (sequence + metric + 7 * i) % width
            near, old = (slot + category + i + 1) % width, (slot + width // 2 + 1) % width
            present = slot in held
            now = held.get(slot, signed(hashed + slot) % 1024)
            held[slot] = then = signed(now + signed(hashed + metric + aux + 29 * i) % 95 + 1)
            neighbour = held.get(near, signed(then + key) % 2048)
            held[near] = neighbour + 1
            if (sequence + i) % stride == 0:
                held.pop(old, None)
            hashed = mix(hashed + (now if present else 0) + then + neighbour + slot)
        return hashed, metric

    return step


def dense_reduce_map(name: str, values: int, width: int, stride: int) -> Step:
    """Running sum, minimum and maximum with value states and two maps; aux is the running sum."""
    width, stride = max(4, width), max(2, stride)

    def step(s: dict, key: int, metric: int, aux: int, category: int, sequence: int) -> tuple[int, int]:
        sample = signed(metric + aux % 4096 + 1)
        total = s["sum"] = signed(s.get("sum", 0) + sample)
        low = s["min"] = min(s.get("min", sample), sample)
        high = s["max"] = max(s.get("max", sample + (category & 31)), sample + (category & 31))
        hashed = mix(total + low + high + sequence)
        for i in range(values):
            now = s.get(i, signed(hashed + i) % 2048)
            s[i] = then = signed(now + signed(total + high + 23 * i) % 83 + 1)
            hashed = mix(hashed + now + then + low)
        for i in range(2):
            held = s.setdefault(("map", i), {})
            slot = signed(key + sequence + 11 * i) % width
            old = (slot + width // 2 + i + 1) % width
            now = held.get(slot, signed(hashed + slot) % 1024)
            held[slot] = then = signed(now + signed(total + high + 31 * i) % 61 + 1)
            if (sequence + i) % stride == 0:
                held.pop(old, None)
            hashed = mix(hashed + now + then + slot)
        return hashed, total

    return step
