"""Keyed state semantics, timers, expiry, golden windows, and restarts that count every row once."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from keyloom.plans import auctions
from keyloom.sources import sinks
from keyloom.streaming import inspection
from keyloom.streaming import processors as P
from keyloom.streaming import queries as Q
from keyloom.streaming.state import Aggregating, List, Map, Reducing, Value
from tests.compare import assert_same


class Semantics(StatefulProcessor):
    """Runs the state API's rules on a key and emits what it saw."""

    def init(self, handle) -> None:
        self.value, self.list, self.map = Value(handle, "value", "long"), List(handle, "list", "string"), Map(handle, "map", "string", "long")
        self.most = Reducing(handle, "most", "long", max)
        self.mean = Aggregating(handle, "mean", "array<long>", lambda: [0, 0], lambda a, x: [a[0] + x, a[1] + 1], lambda a: a[0] // a[1])
        self.other = Value(handle, "other", "long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        seen: list = []
        refused = lambda f, *a: seen.append(self._refused(f, *a))
        seen += [self.value.get(), self.value.add_and_get(1), self.value.add_and_get(2)]
        self.value.update(7)
        self.value.update(None)
        seen += [self.value.get(), self.list.get()]
        self.list.add("x")
        self.list.add_all([])
        self.list.add_all(["y", "z"])
        seen.append(self.list.get())
        for call, value in ((self.list.add, None), (self.list.add_all, None), (self.list.add_all, ["a", None]), (self.list.update, None), (self.list.update, [None]), (self.most.add, None), (self.mean.add, None)):
            refused(call, value)
        seen.append(self.list.get())
        self.list.update(["w"])
        seen.append(self.list.get())
        self.list.update([])
        seen += [self.list.get(), self.map.is_empty()]
        self.map.put("k1", 1)
        self.map.put("k2", None)
        self.map.put_all(None)
        self.map.put_all({"k3": 3})
        seen += [self.map.contains("k2"), self.map.get("k2"), self.map.get("none"), self.map.contains("none"), sorted(self.map.keys()), sorted(self.map.entries(), key=str), len(list(self.map.values()))]
        self.map.remove("k1")
        seen += [self.map.contains("k1"), self.map.add_and_get("n", 5), self.map.add_and_get("n", -2), self.map.is_empty()]
        self.map.clear()
        seen += [self.map.is_empty(), self.most.get(), self.mean.get()]
        for x in (3, 9, 4):
            self.most.add(x)
            self.mean.add(x)
        seen += [self.most.get(), self.mean.get(), self.other.get()]
        self.most.clear()
        seen.append(self.most.get())
        yield pd.DataFrame({"seen": [repr(seen)]})

    def _refused(self, call, value) -> bool:
        try:
            call(value)
        except ValueError:
            return True
        return False

    def close(self) -> None:
        pass


def test_state_semantics(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    got = sinks.drained(P.processed(rows, "id", Semantics, "seen string", "append"), "append").collect()
    want = [
        None, 1, 3, None, [], ["x", "y", "z"], *[True] * 7, ["x", "y", "z"], ["w"], [], True,
        True, None, None, False, ["k1", "k2", "k3"], [("k1", 1), ("k2", None), ("k3", 3)], 3,
        False, 5, 3, False, True, None, None, 9, 5, None, None,
    ]
    assert [r.seen for r in got] == [repr(want)] * 3


def words(spark, path, rows: list[tuple]) -> None:
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(w, start + timedelta(seconds=s)) for w, s in rows], "word string, t timestamp").coalesce(1).write.mode("append").parquet(path)


def test_golden_sliding_window(spark, tmp_path):
    """10 s windows every 5 s over (a,1)(b,2)(a,4)(a,6)(b,11)(a,16), in a stream and in a batch."""
    path = str(tmp_path / "in")
    words(spark, path, [("a", 1), ("b", 2), ("a", 4), ("a", 6), ("b", 11), ("a", 16), ("z", 60)])
    count = lambda df: df.groupBy(F.window("t", "10 seconds", "5 seconds"), "word").count().select(F.second("window.end").alias("end"), F.col("window.end").alias("whole"), "word", "count")
    stream = count(spark.readStream.schema("word string, t timestamp").parquet(path).withWatermark("t", "0 seconds"))
    for rows in (sinks.drained(stream, "append").collect(), count(spark.read.parquet(path)).collect()):
        got = {(r.end, r.word): r["count"] for r in rows if r.word != "z" and r.whole >= datetime(2024, 1, 1, 0, 0, 10)}
        assert got == {(10, "a"): 3, (10, "b"): 1, (15, "a"): 1, (15, "b"): 1, (20, "a"): 1, (20, "b"): 1, (25, "a"): 1}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    """Rows before and after a restart are counted once; a stopped stream's state can be read."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    stream = lambda: P.processed(spark.readStream.schema("key long, sequence long").parquet(source), "key", P.RunningCount, "key long, sequence long, running long", "append")
    for run in range(3):
        spark.range(run * 40, run * 40 + 40).select((F.col("id") % 4).alias("key"), F.col("id").alias("sequence")).write.mode("append").parquet(source)
        sinks.stream_to_files(stream(), out, check, "append").awaitTermination()
    got = {(r.key, r.sequence): r.running for r in spark.read.parquet(out).collect()}
    assert got == {(i % 4, i): i // 4 + 1 for i in range(120)}
    assert sorted(r.key for r in inspection.state_keys(spark, check, "n").collect()) == [0, 1, 2, 3]
    assert {r.key[0]: r.value[0] for r in inspection.state_entries(spark, check, "n").collect()} == dict.fromkeys(range(4), 30)
    assert {r.key: r.value for r in inspection.applied_to_all_keys(spark, check, "n", lambda n: n * 2).collect()} == dict.fromkeys(range(4), 60)


class Expiring(StatefulProcessor):
    """A count that is forgotten a moment after its last write, and a processing-time timer."""

    def init(self, handle) -> None:
        self.handle, self.n = handle, Value(handle, "n", "long", ttl_ms=1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(map(len, rows))
        yield pd.DataFrame({"key": [key[0]], "what": ["count"], "n": [self.n.add_and_get(n)]})
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "what": ["timer"], "n": [0]})

    def close(self) -> None:
        pass


def test_expiry_and_processing_time_timers(spark, tmp_path):
    """Batches go on for the timers' sake, so the query is stopped by the test."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2).toDF("key").coalesce(1).write.parquet(source)
    rows = P.processed(spark.readStream.schema("key long").parquet(source), "key", Expiring, "key long, what string, n long", "append", "ProcessingTime")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()

    def until(batch: int) -> None:
        end = time.monotonic() + 60
        while query.lastProgress is None or query.lastProgress["batchId"] < batch:
            assert query.exception() is None and time.monotonic() < end
            time.sleep(0.2)

    try:
        until(2)
        spark.range(2).toDF("key").coalesce(1).write.mode("append").parquet(source)
        until(query.lastProgress["batchId"] + 3)
    finally:
        query.stop()
    got = [tuple(r) for r in spark.read.parquet(out).select("key", "what", "n").collect()]
    assert sorted(r for r in got if r[1] == "count") == [(0, "count", 1), (0, "count", 1), (1, "count", 1), (1, "count", 1)]
    assert (0, "timer", 0) in got and (1, "timer", 0) in got


def test_two_sides_by_hand(spark, sf_dir):
    rows = sorted(Q.QUERIES["stream_two_sides"](spark, sf_dir).collect(), key=lambda r: r.sequence)
    width, n = P.TwoSides.WIDTH, P.TwoSides.BUCKETS
    state: dict = {}
    for r in rows:
        counts, left, right = state.setdefault(r.key, ({"left": 0, "right": 0}, [0] * n, [0] * n))
        own = left if r.side == "left" else right
        counts[r.side] += 1
        value = counts[r.side]
        for i in range(width):
            own[(r.sequence + i) % n] += 1
            value += own[(r.sequence + i) % n]
        value += counts["right"] if r.side == "left" else sum(left[(r.sequence + i) % n] for i in range(width))
        assert r.value == value
    assert len(rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_partitioned_log_of_a_stream(spark, sf_dir, tmp_path):
    rows = auctions.q10(spark, Q.streamed(sf_dir))
    for _ in range(2):  # the second run finds nothing new
        sinks.write_log_stream(rows, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.csv(str(tmp_path / "log"))
    assert got.count() == auctions.q10(spark, sf_dir).count() and {"dt", "hm"} <= set(got.columns)


@pytest.mark.parametrize("name", ["stream_q18", "stream_q19"])
def test_stream_and_batch_agree(spark, sf_dir, name):
    """Also held against SQL; here against the batch plan where both have its columns."""
    got = Q.QUERIES[name](spark, sf_dir)
    want = auctions.QUERIES[name.removeprefix("stream_")](spark, sf_dir)
    common = [c for c in got.columns if c in want.columns]
    assert common and got.select(common).exceptAll(want.select(common)).isEmpty()


def test_processing_time_windows(spark, tmp_path):
    """Windows of the clock: tumbling and sliding ones close when a later batch begins after them, and hold each row of a
    batch under one time."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("a",), ("b",)], "word string").coalesce(1).write.parquet(source)
    rows = spark.readStream.schema("word string").parquet(source)
    counts = Q.processing_windows(rows, ["word"], "2 seconds", "1 second")
    query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
    try:
        end = time.monotonic() + 90
        found: list = []
        while len(found) < 4:
            assert query.exception() is None and time.monotonic() < end
            spark.createDataFrame([("z",)], "word string").coalesce(1).write.mode("append").parquet(source)
            time.sleep(1)
            found = spark.read.schema(counts.schema).option("recursiveFileLookup", True).parquet(out).where("word <> 'z'").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert sorted((r.word, r.n) for r in found) == [("a", 2), ("a", 2), ("b", 1), ("b", 1)]
    assert len({r.starttime for r in found}) == 2 and all(r.endtime - r.starttime == timedelta(seconds=2) for r in found)
    batch = Q.processing_windows(spark.range(5).withColumn("word", F.lit("w")), ["word"], "1 day").collect()
    assert [r.n for r in batch] == [5]


class Clocked:
    """A state handle whose clock the test sets; values expire as they do with a time to live."""

    def __init__(self) -> None:
        self.now, self.held = 0, {}

    def getValueState(self, name, schema, ttl_ms=None):  # noqa: N802
        handle = self

        class State:
            def exists(self) -> bool:
                return name in handle.held and handle.now < handle.held[name][1] + ttl_ms

            def get(self):
                return handle.held[name][0]

            def update(self, value) -> None:
                handle.held[name] = (value, handle.now)

        return State()


@pytest.mark.parametrize(("refreshes", "want"), [(False, [1, 1, None]), (True, [1, 1, 1])])
def test_time_to_live_counts_from_the_last_write_or_read(refreshes, want):
    handle = Clocked()
    value = Value(handle, "v", "long", ttl_ms=10, read_refreshes=refreshes)
    value.update(1)
    seen = []
    for now in (4, 9, 14):
        handle.now = now
        seen.append(value.get())
    assert seen == want
    handle.now = 60
    assert value.get() is None


@pytest.mark.parametrize(("policy", "closed"), [("min", set()), ("max", {("fast", 0), ("slow", 0)})])
def test_watermark_of_several_inputs(spark, tmp_path, policy, closed):
    """By default the slowest input holds windows open; the fastest closes them if asked to."""
    for name, last in (("fast", 600), ("slow", 5)):
        words(spark, str(tmp_path / name), [(name, 1), (name, last)])
    one, other = (spark.readStream.schema("word string, t timestamp").parquet(str(tmp_path / n)).withWatermark("t", "0 seconds") for n in ("fast", "slow"))
    counts = one.unionByName(other).groupBy(F.window("t", "10 seconds"), "word").count().select("word", (F.unix_seconds("window.start") % 60).alias("start"))
    Q.multiple_inputs(spark, policy)
    try:
        got = {(r.word, r.start) for r in sinks.drained(counts, "append").collect()}
    finally:
        Q.multiple_inputs(spark)
    assert got == closed
    with pytest.raises(ValueError, match="min or max"):
        Q.multiple_inputs(spark, "mean")


def in_pieces(spark, sf_dir, path, name: str, time: str, cuts: list[str]):
    """A table as a stream of several batches, cut at given times."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(time, F.col(time).cast("timestamp"))
    for low, high in zip(["1900-01-01", *cuts], [*cuts, "2100-01-01"], strict=True):
        rows.where((F.col(time) >= low) & (F.col(time) < high)).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def test_closed_auctions_over_several_batches(spark, sf_dir, tmp_path):
    """An auction stays open over batches for as long as a bid within its time may come, and closes once."""
    ends = Q.Ended(spark, sf_dir)
    timed = {n: ends.timed(in_pieces(spark, sf_dir, tmp_path, n, Q.TIMES[n], ["1996-09-01", "1998-05-01", "2000-01-01"]), n, Q.TIMES[n]) for n in ("orders", "lineitem")}
    best = Q.closed(spark, lambda _, name: timed[name], "category", "seller", "initialBid", "expires")
    got = ends.drained(best.withColumn("auction", F.col("id")).drop("opened"))
    assert_same(got, auctions.ORACLE_SQL["q9"], sf_dir)


@pytest.mark.parametrize("name", ["stream_q4", "stream_q9", "stream_q6", "stream_stateful_map", "stream_cep_q3"])
def test_no_call_to_the_state_store_per_value(spark, sf_dir, monkeypatch, name):
    """processed() calls the state store for every value of every key, which takes too long where keys or rows are many."""
    monkeypatch.setattr(P, "processed", lambda *_: pytest.fail("calls per value"))
    assert_same(Q.QUERIES[name](spark, sf_dir), Q.ORACLE_SQL[name], sf_dir)


def test_two_sides_goes_on_over_batches(spark, tmp_path):
    """Buckets and counts of a key are kept from batch to batch; no key calls the state store per value."""
    rows = [(7, "left" if i % 3 else "right", i) for i in range(40)]
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10], "user_id long, side string, sequence long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, side string, sequence long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.sequence: r.value for r in sinks.drained(P.grouped(stream, "user_id", P.TwoSides(), "key long, side string, sequence long, value long"), "append").collect()}
    near = lambda i, j: sum((i + a) % 16 == (j + b) % 16 for a in range(4) for b in range(4))
    for _, side, i in rows:
        own = [j for _, s, j in rows[: i + 1] if s == side]
        left = [j for _, s, j in rows[: i + 1] if s == "left"]
        other = len(rows[: i + 1]) - len(left) if side == "left" else sum(near(i, j) for j in left)
        assert got[i] == len(own) + sum(near(i, j) for j in own) + other


def test_a_right_event_is_held_twice_at_most(spark):
    """Pairs on the edges of pieces and of the cache are found, with points of seconds, and most events go to one piece."""
    start = datetime(2024, 1, 1)
    times = [(k, start + timedelta(seconds=s)) for k, s in enumerate((7199.5, 7200.5, 6000.25, 7200.25, 8400.5, 7200.5, 8400.6, 9600.6, 0.0, 1200.0, 4000.0, 30000.0))]
    events = spark.createDataFrame([(5, k, t) for k, t in times], "user_id long, event_id long, ts timestamp")
    out = Q._two_sided(events)
    want = {(a, b) for a, t in times for b, u in times if a % 2 == 0 and b % 2 == 1 and abs(t - u) <= timedelta(minutes=20)}
    assert want and {(r.left_id, r.right_id) for r in out.collect()} == want and out.count() == len(want)
    span = Q.PIECE_SECONDS
    assert (span + 2 * Q.CACHE_SECONDS) / span < 1.5


def test_sellers_share_a_bucket_and_go_on_over_batches(spark, tmp_path, monkeypatch):
    """A call to Python takes a bucket of sellers, not one; each seller, none too, has averages of its own over batches."""
    keys, grouped = [], P.grouped
    monkeypatch.setattr(P, "grouped", lambda df, key, *rest: keys.append(key) or grouped(df, key, *rest))
    monkeypatch.setattr(P.LastClosed, "BUCKETS", 2)
    day = 86_400_000_000
    rows = [(s or None, 100 * i + s, 7 * i * i + s, day * (300 * i + 7 * (s % 3) + 1)) for s in range(12) for i in range(s % 4 * 8 + 1)]
    rows += [(-(2**63), 1, 5, day), (0, 2, 5, day), (2**63 - 1, 3, 5, day)]
    for low in range(0, 9000, 3000):
        part = [(*r, datetime(1970, 1, 1) + timedelta(microseconds=r[3])) for r in rows if low * day <= r[3] < (low + 3000) * day]
        spark.createDataFrame(part, "seller long, id long, price long, micros long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seller long, id long, price long, micros long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ends = Q.Ended(spark, str(tmp_path))
    timed = ends.timed(stream, "winners", "at").where(F.col("at") < F.lit(Q.END).cast("timestamp"))
    got = sorted(map(str, ends.drained(Q.last_closed(timed)).select("seller", "id", "avg_price").toArrow().to_pylist()))
    want = []
    for seller in {r[0] for r in rows}:
        won = sorted((r[3], r[1], r[2]) for r in rows if r[0] == seller)
        for k, (_, i, _) in enumerate(won):
            last = [p for *_, p in won[max(0, k - 10) : k + 1]]
            want.append(str({"seller": seller, "id": i, "avg_price": sum(last) // len(last)}))
    assert got == sorted(want) and keys == ["bucket"]
