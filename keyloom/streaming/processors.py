"""Stateful processors for what Structured Streaming's own operators cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from keyloom.operators.patterns import Pattern, match_at
from keyloom.streaming.state import Map, Value

EPOCH = datetime(1970, 1, 1)


class RunningCount(StatefulProcessor):
    """(key, sequence, running count) for every row of a key, in order of sequence within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = Value(handle, "n", "long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get() or 0
        for part in rows:
            part = part.sort_values("sequence")
            yield pd.DataFrame({"key": key[0], "sequence": part["sequence"], "running": range(n + 1, n + 1 + len(part))})
            n += len(part)
        self.n.update(n)

    def close(self) -> None:
        pass


class TopN(StatefulProcessor):
    """A key's ten best rows (by score descending, then id), emitted anew whenever they change."""

    N = 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = Map(handle, "best", "long", "long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.best.entries())
        for part in rows:
            fresh = part.sort_values(["score", "id"], ascending=[False, True]).head(self.N)
            held |= dict(zip(fresh["id"].tolist(), fresh["score"].tolist(), strict=True))
        ranked = sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.N]
        self.best.clear()
        self.best.put_all(dict(ranked))
        yield pd.DataFrame({"key": key[0], "id": [i for i, _ in ranked], "score": [s for _, s in ranked], "rank_number": range(1, len(ranked) + 1)})

    def close(self) -> None:
        pass


class TwoSides:
    """Rows of two tagged sides meet per key: each counts its own side and a bucket of its sequence number.

    value is the own count with the sum of `width` adjacent buckets of the own side; a left row adds the
    right side's count, a right row the left side's buckets. A key's counts are read and written once a batch.
    """

    WIDTH, BUCKETS = 4, 16
    STATE = "counts array<long>, left array<long>, right array<long>"

    def rows(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([0, 0], [0] * self.BUCKETS, [0] * self.BUCKETS)
        counts, left, right = (list(values) for values in held)
        for part in parts:
            part = part.sort_values(["sequence", "side"])
            values = []
            for side, sequence in zip(part["side"].tolist(), part["sequence"].tolist(), strict=True):
                is_right = int(side != "left")
                own = right if is_right else left
                near = [(sequence + i) % self.BUCKETS for i in range(self.WIDTH)]
                counts[is_right] += 1
                for k in near:
                    own[k] += 1
                values.append(counts[is_right] + sum(own[k] for k in near) + (sum(left[k] for k in near) if is_right else counts[1]))
            yield pd.DataFrame({"key": key[0], "side": part["side"], "sequence": part["sequence"], "value": values})
        state.update((counts, left, right))


class Idle(StatefulProcessor):
    """Emits (key, last) when event time has passed a key's last row by more than GAP_MS: an event-time timer."""

    GAP_MS = 6 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, Value(handle, "last", "long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max([self.last.get() or 0, *(int(part["ms"].max()) for part in rows)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(latest)
        self.handle.registerTimer(latest + self.GAP_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "last": [last]})

    def close(self) -> None:
        pass


class LastClosed:
    """Per seller the sum and number of the prices of the last WIDTH closed auctions, at each of them in order of their
    winning bids. A key is a bucket of sellers, whose rows are reckoned together: a call per seller takes too long.

    A winner waits until event time is OPEN_MS past its bid: by then every auction that was open at the bid has closed.
    Of what is told, the state holds a seller's last WIDTH - 1 prices, in their order and with the time TOLD.
    """

    WIDTH, BUCKETS = 11, 2048
    TOLD = -(2**63)
    STATE = "seller array<long>, micros array<long>, id array<long>, price array<long>"
    COLUMNS = ("seller", "micros", "id", "price")

    def __init__(self, open_ms: int):
        self.open_ms = open_ms

    def rows(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [state.get if state.exists else ([],) * 4]
        held += [[part[c].astype("int64") for c in self.COLUMNS] for part in (() if state.hasTimedOut else parts)]
        seller, micros, ids, price = (np.concatenate([np.asarray(c, "int64") for c in values]) for values in zip(*held, strict=True))
        order = np.lexsort((ids, micros, seller))
        seller, micros, ids, price = seller[order], micros[order], ids[order], price[order]
        total, n = price.copy(), np.ones(len(price), "int64")
        for back in range(1, self.WIDTH):
            same = seller[back:] == seller[:-back]
            total[back:] += np.where(same, price[:-back], 0)
            n[back:] += same
        ready = micros // 1000 + self.open_ms < state.getCurrentWatermarkMs()
        fresh = ready & (micros != self.TOLD)
        last = np.flatnonzero(ready)
        behind = self.WIDTH - 1
        last = last[np.append(seller[last[:-behind]] != seller[last[behind:]], np.ones(min(behind, len(last)), bool))]
        kept = ~ready
        kept[last] = True
        state.update(tuple(c[kept].tolist() for c in (seller, np.where(ready, self.TOLD, micros), np.where(ready, 0, ids), price)))
        if not ready.all():
            state.setTimeoutTimestamp(int(micros[~ready].min()) // 1000 + self.open_ms + 1)
        if fresh.any():
            yield pd.DataFrame({"bucket": key[0], "seller": seller[fresh], "id": ids[fresh], "total": total[fresh], "n": n[fresh]})


class Touch:
    """Reads and writes a value of SIZE bytes for every row, which passes through; the state store is read before a key's
    first row of a batch and written after its last."""

    SIZE = 100
    STATE = "value binary"

    def rows(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for part in parts:
            for _ in range(len(part)):
                value = bytes(len(value or ()) or self.SIZE)
            yield pd.DataFrame({"key": key[0], "sequence": part["sequence"]})
        state.update((value,))


class Drops:
    """Matches a time-bounded pattern over a key's rows (micros, event_id, price) in order of event time.

    Rows wait until the watermark has passed the longest match that may start at them; a timeout
    comes back for them. What a match skips over goes, so the state holds one match's span of time.
    """

    STATE = "micros array<long>, event_id array<long>, price array<long>"

    def __init__(self, pattern: Pattern):
        self.pattern = pattern
        self.within = pattern.within // timedelta(microseconds=1)

    def rows(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in () if state.hasTimedOut else parts:
            held += zip(part["micros"].tolist(), part["event_id"].tolist(), part["price"].tolist(), strict=True)
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000 - self.within
        at, found = 0, []
        rows = [{"dateTime": EPOCH + timedelta(microseconds=m), "price": p} for m, _, p in held] if held[0][0] <= passed else []
        while at < len(held) and held[at][0] <= passed:
            got = match_at(rows, at, self.pattern, "dateTime")
            if got is not None:
                found.append(self.pattern.measures(got[0]))
            at = got[2] if got is not None else at + 1
        left = held[at:]
        if left:
            state.update(columns(left, 3))
            state.setTimeoutTimestamp((left[0][0] + self.within) // 1000 + 1)
        else:
            state.remove()
        if found:
            yield pd.DataFrame({"bidder": key[0], "micros": [(t - EPOCH) // timedelta(microseconds=1) for t, _ in found], "drop_diff": [d for _, d in found]})


def columns(rows: list[tuple], n: int) -> tuple[list, ...]:
    """Rows of n values as n lists."""
    return tuple(map(list, zip(*rows, strict=True))) if rows else tuple([] for _ in range(n))


def in_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on lives in RocksDB, so it may outgrow memory. Its rows are not counted, since
    a count takes a read before every write."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def processed(df: DataFrame, key: str, processor: Callable[[], StatefulProcessor], schema: str, mode: str = "update", time_mode: str = "None") -> DataFrame:
    """df's rows through a processor per key."""
    in_rocksdb(df.sparkSession)
    return df.groupBy(key).transformWithStateInPandas(processor(), schema, mode, time_mode)


def grouped(df: DataFrame, key: str, processor: TwoSides | LastClosed | Touch | Drops, schema: str, timeout: str = "NoTimeout") -> DataFrame:
    """df's rows through a processor per key whose state, one row, comes and goes with them in batches of many keys, where
    processed() calls the state store anew for every value. For short rows of state; a timeout of event time may be set."""
    in_rocksdb(df.sparkSession)
    return df.groupBy(key).applyInPandasWithState(processor.rows, schema, processor.STATE, "append", timeout)
