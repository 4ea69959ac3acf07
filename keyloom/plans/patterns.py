"""Pattern queries over the bids of a bidder."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keyloom.operators.patterns import Pattern, match_recognize
from keyloom.sources import views

TIME, LONG = T.TimestampNTZType(), T.LongType()
MEAN, DROP, WITHIN = 3000, 50, timedelta(hours=10)


def _columns(*names: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in names])


def _falling(row: dict, bound: dict) -> bool:
    down = bound["DOWN"]
    return row["price"] < (bound["START"][0]["price"] if len(down) == 1 else down[-2]["price"])


def _rising(row: dict, bound: dict) -> bool:
    # LAST(DOWN.price, 1): the fall before the last one; without it the condition is not met.
    down = bound["DOWN"]
    return len(down) > 1 and row["price"] > down[-2]["price"]


V_SHAPE = Pattern(
    (("START", ""), ("DOWN", "+"), ("UP", "")),
    lambda b: (b["START"][0]["dateTime"], b["DOWN"][-1]["dateTime"], b["UP"][-1]["dateTime"]),
    {"DOWN": _falling, "UP": _rising},
    "to_last UP",
)


def _cheap(row: dict, bound: dict) -> bool:
    return bound["A"].total("price") < MEAN * len(bound["A"])


def _run(bound: dict) -> tuple:
    a = bound["A"]
    return a[0]["dateTime"], a[-1]["dateTime"], a.total("price") // len(a)


CHEAP_RUN = Pattern((("A", "+"), ("B", "")), _run, {"A": _cheap})
CHEAP_RUNS = Pattern((("A", "+"), ("B", "")), _run, {"A": _cheap}, "next_row")
SUDDEN_DROP = Pattern(
    (("A", ""), ("B", "*"), ("C", "")),
    lambda b: (b["C"][0]["dateTime"], b["A"][0]["price"] - b["C"][0]["price"]),
    {"B": lambda r, b: r["price"] > b["A"][0]["price"] - DROP, "C": lambda r, b: r["price"] < b["A"][0]["price"] - DROP},
    within=WITHIN,
)
RUN_COLUMNS = _columns(("start_tstamp", TIME), ("end_tstamp", TIME), ("avg_price", LONG))
PATTERNS = {
    "cep_q0": (V_SHAPE, _columns(("start_tstamp", TIME), ("bottom_tstamp", TIME), ("end_tstamp", TIME))),
    "cep_q1": (CHEAP_RUN, RUN_COLUMNS),
    "cep_q2": (CHEAP_RUNS, RUN_COLUMNS),
    "cep_q3": (SUDDEN_DROP, _columns(("drop_time", TIME), ("drop_diff", LONG))),
}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pattern, schema = PATTERNS[name]
        bids = views.bid_ev(spark, sf_dir).select("bidder", "dateTime", "event_id", "price")
        return match_recognize(bids, ["bidder"], "dateTime", pattern, schema, ["event_id"])

    return run


QUERIES = {n: _query(n) for n in PATTERNS}
_BIDS = 'SELECT user_id AS bidder, ts AS t, event_id, CAST(round(value * 100) AS BIGINT) AS price FROM events'


_B = f"b AS (SELECT *, row_number() OVER (PARTITION BY bidder ORDER BY t, event_id) AS k FROM ({_BIDS}))"


def first_after_each(columns: str, after: str) -> str:
    """Of the matches ok (bidder, s, e, columns) the first of every bidder, then each time the first after the last one."""
    empty = ", ".join(f"CAST(NULL AS {'BIGINT' if c in ('avg_price', 'drop_diff') else 'TIMESTAMP'}) AS {c}" for c in columns.split(", "))
    picked = ", ".join(f"ok.{c}" for c in columns.split(", "))
    return f"""r AS (SELECT bidder, CAST(0 AS BIGINT) AS e, {empty} FROM (SELECT DISTINCT bidder FROM b)
 UNION ALL SELECT n.bidder, n.e, {", ".join(f"n.{c}" for c in columns.split(", "))} FROM r, LATERAL (SELECT ok.bidder, ok.e, {picked} FROM ok WHERE ok.bidder = r.bidder AND ok.s {after} r.e ORDER BY ok.s LIMIT 1) n)
SELECT bidder, {columns} FROM r WHERE e > 0"""


# A match begins before two falls or more and ends at the next row that is no fall, if it is above the last fall but one.
_V_SHAPES = f"""
WITH RECURSIVE {_B},
u AS (SELECT *, min(CASE WHEN level THEN k END) OVER (PARTITION BY bidder ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM (SELECT *, price >= lag(price) OVER (PARTITION BY bidder ORDER BY k) AS level FROM b)),
ok AS (SELECT u.bidder, u.k AS s, u.e, u.t AS start_tstamp, low.t AS bottom_tstamp, top.t AS end_tstamp FROM u JOIN b top ON top.bidder = u.bidder AND top.k = u.e JOIN b low ON low.bidder = u.bidder AND low.k = u.e - 1
 JOIN b mid ON mid.bidder = u.bidder AND mid.k = u.e - 2 WHERE u.e - u.k >= 3 AND top.price > mid.price),
{first_after_each("start_tstamp, bottom_tstamp, end_tstamp", ">=")}"""
# p: how far the prices up to a row are above the mean in all. A run lasts until p is no lower than before its first row.
_CHEAP = f"""{_B},
c AS (SELECT *, sum(price - {MEAN}) OVER (PARTITION BY bidder ORDER BY k) AS p, sum(price) OVER (PARTITION BY bidder ORDER BY k) AS total, max(k) OVER (PARTITION BY bidder) AS n FROM b),
j AS (SELECT a.bidder, a.k AS s, any_value(a.t) AS t, any_value(a.total - a.price) AS before, coalesce(min(z.k), any_value(a.n)) AS e FROM c a LEFT JOIN c z ON z.bidder = a.bidder AND z.k >= a.k AND z.p >= a.p - (a.price - {MEAN}) GROUP BY a.bidder, a.k),
ok AS (SELECT j.bidder, j.s, j.e, j.t AS start_tstamp, l.t AS end_tstamp, CAST((l.total - j.before) // (j.e - j.s) AS BIGINT) AS avg_price FROM j JOIN c l ON l.bidder = j.bidder AND l.k = j.e - 1 WHERE j.e > j.s)"""
_DROPS = f"""
WITH RECURSIVE {_B},
m AS (SELECT a.bidder, a.k AS s, min(c.k) AS e FROM b a JOIN b c ON a.bidder = c.bidder AND c.k > a.k AND c.t - a.t < INTERVAL 10 HOURS AND c.price <= a.price - {DROP} GROUP BY 1, 2),
ok AS (SELECT m.bidder, s, e, c.t AS drop_time, a.price - c.price AS drop_diff FROM m JOIN b c ON c.bidder = m.bidder AND c.k = m.e JOIN b a ON a.bidder = m.bidder AND a.k = m.s WHERE c.price < a.price - {DROP}),
{first_after_each("drop_time, drop_diff", ">")}"""

ORACLE_SQL = {
    "cep_q0": _V_SHAPES,
    "cep_q1": f"WITH RECURSIVE {_CHEAP}, {first_after_each('start_tstamp, end_tstamp, avg_price', '>')}",
    "cep_q2": f"WITH {_CHEAP} SELECT bidder, start_tstamp, end_tstamp, avg_price FROM ok",
    "cep_q3": _DROPS,
}
