"""Operators against plain Python: recurrences, patterns, running totals of hot keys, lookups, sinks."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.scalars import count_char, positive_mod, regexp_extract_or_null, split_index
from keyloom.operators import recurrent as R
from keyloom.operators.aggregates import Aggregate, aggregated, reducing
from keyloom.operators.lookups import looked_up
from keyloom.operators.modules import COLUMNS, MODULES
from keyloom.operators.patterns import Pattern, Rows, match_recognize, matches
from keyloom.operators.running import running, running_in_key
from keyloom.plans import applications
from keyloom.sources import sinks

LONGS = ", ".join(f"{c} long" for c in COLUMNS)


def rows(seed: int, n: int = 400, keys: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.randrange(keys) if rng.random() < 0.6 else 0, rng.randrange(1, 1001), rng.randrange(97), rng.randrange(8), i, 0) for i in range(n)]


@pytest.mark.parametrize("name", sorted(applications.STEPS))
def test_recurrences_by_key_in_order(spark, name):
    data = rows(1)
    shuffled = data[:]
    random.Random(2).shuffle(shuffled)
    got = sorted(tuple(r) for r in R.keyed(spark.createDataFrame(shuffled, LONGS).repartition(3), applications.STEPS[name]).collect())
    want, states = [], {}
    for key, metric, aux, category, sequence, branch in data:
        m, a = applications.STEPS[name](states.setdefault(key, {}), key, metric, aux, category, sequence)
        want.append((key, m, a, category, sequence, branch))
    assert got == sorted(want)


def test_fraud_score_and_moving_average_by_hand():
    s: dict = {}
    assert R.predict(s, 1, 10, 0, 2, 5) == (5, 1)  # (0 + 0 + 0 + 10) / 2
    assert R.predict(s, 1, 7, 0, 3, 9) == (18, 2)  # (15 + 11 + 4 + 7) / 2
    s = {}
    assert [R.moving_average(s, 1, m, 2, 0, 0)[0] for m in (4, 8, 10, 0)] == [4, 6, 8, 4]  # a full window collapses to its average


def test_wrapping_arithmetic():
    assert R.signed(1 << 63) == -(1 << 63) and R.signed(-1) == -1
    assert R.divided(-7, 2) == -3 and R.divided(7, -2) == -3
    assert R.string_hash("hello") == 99162322 and R.string_hash("polygenelubricants") == -(1 << 31)
    assert all(-(1 << 63) <= R.mix(x) < 1 << 63 for x in (0, 1, -1, 1 << 62))


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_running_totals_of_a_hot_key(spark, block):
    data = rows(3)
    df = running(spark.createDataFrame(data, LONGS).repartition(4), {"s": "metric"}, {"was": "aux"}, block=block)
    got = {(r.key, r.sequence): (r.s, r.was) for r in df.collect()}
    sums, last = {}, {}
    for key, metric, aux, _, sequence, _ in data:
        sums[key] = sums.get(key, 0) + metric
        assert got[key, sequence] == (sums[key], last.get(key))
        last[key] = aux


def test_running_totals_in_one_window_are_the_same(spark):
    df = spark.createDataFrame([(k, m - 500, a, c, s, b) for k, m, a, c, s, b in rows(5)], LONGS).repartition(4)
    for n, m in MODULES.items():
        one, other = (sorted(map(tuple, m.apply(df, spread=spread).collect())) for spread in (True, False))
        assert one == other, n
    assert sorted(map(tuple, running(df, {"s": "metric"}, block=16, wrap=True).collect())) == sorted(map(tuple, running_in_key(df, {"s": "metric"}, wrap=True).collect()))


def test_remainders_are_not_negative(spark):
    df = spark.createDataFrame([(1, -7, -3, 1, 0, 0)], LONGS)
    got = {n: tuple(MODULES[n].apply(df).first())[:3] for n in ("geo_finder", "map_match", "geo_status", "encr", "toll_notification", "daily_expenses", "rcrf")}
    assert got == {
        "geo_finder": (1, 241, 4002), "map_match": (780, -7, -220), "geo_status": (1, 1, 1), "encr": (1, 4, 0), "toll_notification": (1, 18, 0), "daily_expenses": (1, 40, -7), "rcrf": (1, 1, 0),
    }


def test_applications_of_hot_keys_are_the_same(spark, sf_dir, monkeypatch):
    """With keys over a block, operators spread them and write rows in between; results don't change."""
    source = applications.rows(spark, sf_dir).where("sequence < 200")
    names = ("app_lg", "app_vs", "app_lr_plain", "app_sd")
    want = {n: sorted(map(tuple, applications.APPLICATIONS[n](applications.Spark(), source).collect())) for n in names}
    monkeypatch.setattr(applications, "BLOCK", 2)
    assert {n: sorted(map(tuple, applications.APPLICATIONS[n](applications.Spark(), source).collect())) for n in names} == want


def test_running_sums_wrap(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([(1, big, 0, 0, i, 0) for i in range(3)], LONGS)
    got = sorted((r.sequence, r.metric) for r in MODULES["count"].apply(df, wrap=True).collect())
    assert [m for _, m in got] == [big, R.signed(2 * big), R.signed(3 * big)]


def test_every_module_on_no_rows(spark):
    none = spark.createDataFrame([], LONGS)
    assert all(m.apply(none).count() == 0 for m in MODULES.values())
    assert all(R.keyed(none, s).count() == 0 for s in applications.STEPS.values())


START = datetime(2024, 1, 1)


def by_regex(values: str, expression: str, skip: str) -> list[str]:
    """Matches of a regular expression over one letter a row, with the skip mode's start places."""
    out, at = [], 0
    compiled = re.compile(expression)
    while at < len(values):
        m = compiled.match(values, at)
        if m is None:
            at += 1
            continue
        out.append(m[0])
        at = {"past_last": m.end(), "next_row": at + 1, "to_last B": max(m.end("B") - 1, at + 1), "to_first B": max(m.start("B"), at + 1)}[skip]
    return out


@pytest.mark.parametrize("skip", ["past_last", "next_row", "to_last B", "to_first B"])
def test_patterns_match_as_regular_expressions_do(skip):
    rng = random.Random(4)
    define = {"A": lambda r, b: r["v"] in "ax", "B": lambda r, b: r["v"] in "bx", "C": lambda r, b: r["v"] in "cxb"}
    for quantifiers, expression in ((("", "+", ""), "[ax](?P<B>[bx]+)[cxb]"), (("+", "+", "*"), "[ax]+(?P<B>[bx]+)[cxb]*"), (("*", "+", ""), "[ax]*(?P<B>[bx]+)[cxb]")):
        for _ in range(60):
            values = "".join(rng.choice("aabbcxz") for _ in range(30))
            data = [{"t": START + timedelta(seconds=i), "v": v} for i, v in enumerate(values)]
            pattern = Pattern(tuple(zip("ABC", quantifiers, strict=True)), lambda b: tuple(r["v"] for n in "ABC" for r in b[n]), define, skip)
            assert ["".join(m) for m in matches(data, pattern, "t")] == by_regex(values, expression, skip)


def test_patterns_within_a_time_and_by_key(spark):
    data = [(k, START + timedelta(seconds=s), s) for k in (1, 2) for s in (0, 4, 9, 10)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, s long").repartition(3)
    pattern = Pattern((("A", ""), ("B", "")), lambda b: (b["A"][0]["s"], b["B"][0]["s"]), {"B": lambda r, b: True}, "next_row", timedelta(seconds=5))
    out = match_recognize(df, ["k"], "t", pattern, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    assert sorted(tuple(r) for r in out.collect()) == [(k, a, b) for k in (1, 2) for a, b in ((0, 4), (9, 10))]
    assert match_recognize(df.limit(0), ["k"], "t", pattern, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).count() == 0


@pytest.mark.parametrize("skip", ["past_last", "next_row", "to_last B"])
def test_patterns_over_pieces_of_a_key(skip):
    """Rows that come piece by piece give the same matches, and no more are held than an open match needs."""
    rng = random.Random(6)
    define = {"A": lambda r, b: r["v"] == "a", "B": lambda r, b: r["v"] == "b", "C": lambda r, b: r["v"] in "bc"}
    pattern = Pattern((("A", ""), ("B", "+"), ("C", "")), lambda b: tuple(r["t"] for n in "ABC" for r in b[n]), define, skip)
    for _ in range(60):
        data = [{"t": i, "v": rng.choice("aabbbc")} for i in range(40)]
        held, got, at = [], [], 0
        while at < len(data):
            step = rng.randint(1, 6)
            held += data[at : at + step]
            at += step
            got += matches(held, pattern, "t", False)
            assert not held or held[0]["v"] == "a"
        got += matches(held, pattern, "t")
        assert got == list(matches(list(data), pattern, "t")) and not held


def test_bound_rows_keep_totals():
    rng, bound, plain = random.Random(8), Rows(), []
    for _ in range(200):
        if plain and rng.random() < 0.4:
            assert bound.pop() == plain.pop()
        else:
            row = {"p": rng.randrange(9)}
            bound.append(row)
            plain.append(row)
        assert bound.total("p") == sum(r["p"] for r in plain)


def test_v_shapes_by_hand(spark):
    from keyloom.plans.patterns import V_SHAPE

    prices = [10, 8, 6, 9, 7, 12]
    data = [{"dateTime": START + timedelta(hours=i), "price": p} for i, p in enumerate(prices)]
    assert list(matches(data, V_SHAPE, "dateTime")) == [(START, START + timedelta(hours=2), START + timedelta(hours=3))]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a/b//c", -7), (None, None), ("", 5)], "s string, n long")
    got = df.select(split_index(F.col("s"), "/", 1), split_index(F.col("s"), "/", 3), split_index(F.col("s"), "/", 9), regexp_extract_or_null(F.col("s"), "(b)", 1), count_char(F.col("s"), "/"), positive_mod(F.col("n"), 3)).collect()
    assert [tuple(r) for r in got] == [("b", "c", None, "b", 3, 2), (None, None, None, None, 0, None), (None, None, None, None, 0, 2)]


def test_lookups_keep_order_and_ask_once(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id"), F.lit("x").alias("Answer")).coalesce(1)
    got = looked_up(df, "k", lambda k: None if k == 3 else f"v{k}", "answer", T.StringType(), 8).collect()
    assert [(r.id, r.answer) for r in got] == [(i, None if i % 7 == 3 else f"v{i % 7}") for i in range(200)]


def test_user_defined_aggregates(spark):
    mean = Aggregate(lambda: (0, 0), lambda a, x: (a[0] + x, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: a[0] / a[1] if a[1] else None)
    data = [(i % 3 if i % 10 else None, i if i % 4 else None) for i in range(500)] + [(9, None)]
    df = spark.createDataFrame(data, "k long, v long").repartition(4)
    got = {r.k: r.mean for r in aggregated(df, ["k"], "v", mean, "mean", T.DoubleType()).collect()}
    for key in {k for k, _ in data}:
        values = [v for k, v in data if k == key and v is not None]
        assert got[key] == (sum(values) / len(values) if values else None)
    most = {r.k: r.most for r in aggregated(df, ["k"], "v", reducing(max), "most", T.LongType()).collect()}
    assert most == {k: max((v for q, v in data if q == k and v is not None), default=None) for k in most}
    assert aggregated(df.limit(0), ["k"], "v", mean, "mean", T.DoubleType()).count() == 0


def test_partitioned_log_and_measures(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", "10:00"), (2, "2024-01-01", "10:01"), (3, "2024-01-02", "10:00")], "v int, dt string, hm string")
    sinks.write_log(df, str(tmp_path / "log"))
    assert (tmp_path / "log" / "_SUCCESS").exists() and (tmp_path / "log" / "dt=2024-01-02").is_dir()
    assert spark.read.csv(str(tmp_path / "log")).where("dt = '2024-01-01'").count() == 2
    assert sinks.measured(df)["rows"] == 3
