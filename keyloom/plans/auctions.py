"""The auction query suite, q0 to q22, on the driver tables.

Time windows are hours where the tables' events are days apart; sizes are constants here. Every oracle is
the same question in DuckDB SQL, written independently of the plan.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.scalars import count_char, regexp_extract_or_null, split_index
from keyloom.operators import windows as win
from keyloom.sources import views
from keyloom.sources.generators import side_input

RATE = Decimal("0.908")
HOP, SLIDE, TUMBLE, GAP, NEWCOMERS = "10 hours", "2 hours", "10 hours", "6 hours", "30 days"
STATES = ("AMERICA", "ASIA", "EUROPE")
CHANNEL_ID = r"(&|^)channel_id=([^&]*)"

# The oracle's views, spelt once.
BID = "(SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_returnflag AS channel, l_shipdate AS dt FROM lineitem)"
AUCTION = f"(SELECT o_orderkey AS id, o_custkey AS seller, CAST(10 + o_orderkey % 5 AS BIGINT) AS category, o_orderdate AS dt, o_orderdate + INTERVAL {views.OPEN_DAYS} DAYS AS expires, CAST(round(o_totalprice * 100) AS BIGINT) AS initial FROM orders)"
PERSON = "(SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
BID_EV = (
    "(SELECT event_id, event_id % 100 AS auction, user_id AS bidder, CAST(round(value * 100) AS BIGINT) AS price, "
    "CASE WHEN event_id % 2 = 0 THEN (['Apple', 'Google', 'Facebook', 'Baidu'])[CAST((event_id // 2) % 4 + 1 AS INTEGER)] ELSE 'channel-' || event_id % 1000 END AS channel, "
    f"'{views.URL}' || CASE WHEN event_id % 2 = 1 AND event_id % 20 <> 1 THEN '&channel_id=' || event_id % 1000 ELSE '' END AS url, ts AS dt, props AS extra FROM events)"
)
EPOCH = "TIMESTAMP '1970-01-01'"


def _hop_rows(size: int, slide: int, keys: str) -> str:
    return f"(SELECT {keys}, time_bucket(INTERVAL {slide} HOURS, dt, {EPOCH}) - to_hours({slide} * k) AS starttime FROM {BID_EV}, (SELECT unnest(range({size // slide})) AS k))"


def discounted() -> Column:
    """0.908 times the price, as DECIMAL(23, 3)."""
    return (F.lit(RATE) * F.col("price")).cast("decimal(23,3)")


def q0(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Pass-through projection."""
    return views.bid_ev(spark, sf_dir).select("auction", "bidder", "price", F.col("dateTime").alias("dt"), "extra")


def q1(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Currency conversion with exact decimals."""
    return views.bid_ev(spark, sf_dir).select("auction", "bidder", discounted().alias("price"), F.col("dateTime").alias("dt"), "extra")


def q2(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids of every 123rd auction."""
    return views.bid(spark, sf_dir).where(F.col("auction") % 123 == 0).select("auction", "price")


def q3(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Sellers of three places with auctions of one category; both filters reach the scans."""
    a = views.auction(spark, sf_dir).where("category = 10").alias("a")
    p = views.person(spark, sf_dir).where(F.col("state").isin(*STATES)).alias("p")
    return a.join(p, F.col("a.seller") == F.col("p.id")).select("p.name", "p.city", "p.state", F.col("a.id").alias("id"))


def _bids_in_time(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    a, b = views.auction(spark, sf_dir).alias("a"), views.bid(spark, sf_dir).alias("b")
    return win.interval_join(a, b, F.col("a.id") == F.col("b.auction"), F.col("b.dateTime"), F.col("a.dateTime"), F.col("a.expires"))


def q4(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Average closing price by category."""
    closing = _bids_in_time(spark, sf_dir).groupBy("a.id", "a.category").agg(F.max("b.price").alias("final"))
    return closing.groupBy("category").agg(F.expr("sum(final) div count(final)").alias("avg_price"))


def q5(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Hottest auctions of each sliding window, ties kept.

    The maximum is a window function over counts that are few by then, not a self-join of the counts.
    """
    counts = q5_steady(spark, sf_dir)
    return counts.withColumn("best", F.max("num").over(Window.partitionBy("starttime"))).where("num >= best").drop("best")


def q5_steady(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Every auction's count in each sliding window."""
    return win.hop(views.bid_ev(spark, sf_dir), "dateTime", HOP, SLIDE, "auction").agg(F.count("*").alias("num"))


def q6(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Average price of a seller's last eleven closed auctions, at each of them."""
    best = win.top_n(
        _bids_in_time(spark, sf_dir).select("a.id", "a.seller", "b.price", F.col("b.dateTime").alias("dt"), "b.bidder"), 1, ["id"], F.desc("price"), F.asc("dt"), F.asc("bidder")
    )
    w = Window.partitionBy("seller").orderBy("dt", "id").rowsBetween(-10, 0)
    return best.select("seller", "id", F.sum("price").over(w).alias("s"), F.count("price").over(w).alias("n")).select("seller", "id", F.expr("s div n").alias("avg_price"))


def q7(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Highest bids of each tumbling window."""
    b = views.bid_ev(spark, sf_dir).withColumn("w", F.window("dateTime", TUMBLE))
    top = b.groupBy("w").agg(F.max("price").alias("best"))
    return b.join(top, "w").where("price = best").select("auction", "price", "bidder", F.col("dateTime").alias("dt"), "extra")


def q8(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """People who opened an auction in the window in which they came."""
    p = win.tumble(views.people_since(spark, sf_dir), "dateTime", NEWCOMERS, "id", "name").agg(F.count("*").alias("n")).drop("n")
    a = win.tumble(views.auction(spark, sf_dir), "dateTime", NEWCOMERS, "seller").agg(F.count("*").alias("n")).select("seller", F.col("starttime").alias("s"))
    return p.join(a, (p.id == a.seller) & (p.starttime == a.s)).select("id", "name", "starttime")


def q9(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """The winning bid of every auction."""
    rows = _bids_in_time(spark, sf_dir).select("a.id", "a.category", "a.seller", "a.initialBid", "a.expires", "b.auction", "b.bidder", "b.price", F.col("b.dateTime").alias("dt"))
    return win.top_n(rows, 1, ["id"], F.desc("price"), F.asc("dt"), F.asc("bidder")).drop("rank_number")


def q10(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids with the day and minute that partition their log (keyloom.sources.sinks writes it)."""
    return views.bid_ev(spark, sf_dir).select(
        "auction", "bidder", "price", F.col("dateTime").alias("at"), "extra", F.date_format("dateTime", "yyyy-MM-dd").alias("dt"), F.date_format("dateTime", "HH:mm").alias("hm")
    )


def q11(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids per bidder and session."""
    return win.session(views.bid_ev(spark, sf_dir), "dateTime", GAP, "bidder").agg(F.count("*").alias("bid_count"))


def q12(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids per bidder and tumbling window; the time column stands in for the processing clock."""
    return win.tumble(views.bid_ev(spark, sf_dir), "dateTime", TUMBLE, "bidder").agg(F.count("*").alias("bid_count"))


def q13(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Lookup join with a side table of fixed size."""
    b, s = views.bid(spark, sf_dir), side_input(spark)
    return b.join(F.broadcast(s), b.auction % 10_000 == s.key).select("auction", "bidder", "price", F.col("dateTime").alias("dt"), "value")


def q14(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids of a price range with the time of day and a count of one letter."""
    hour = F.hour("dateTime")
    kind = F.when((hour >= 8) & (hour <= 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    b = views.bid_ev(spark, sf_dir).withColumn("price", discounted()).where((F.col("price") > 1000) & (F.col("price") < 50_000_000))
    return b.select("auction", "bidder", "price", kind.alias("bid_time_type"), F.col("dateTime").alias("dt"), "extra", count_char(F.col("extra"), "c").alias("c_counts"))


LOW, HIGH = 1000, 10_000


def bands() -> dict[str, Column]:
    """Price bands by name."""
    price = F.col("price")
    return {"total": F.lit(True), "rank1": price < LOW, "rank2": (price >= LOW) & (price < HIGH), "rank3": price >= HIGH}


def _ranks() -> list[Column]:
    out = [F.count_if(cond).alias(f"{name}_bids") for name, cond in bands().items()]
    for what, column in (("bidders", "bidder"), ("auctions", "auction")):
        out += [F.count_distinct(F.when(cond, F.col(column))).alias(f"{name}_{what}") for name, cond in bands().items()]
    return out


def q15(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids, bidders and auctions of a day by price band."""
    return views.bid_ev(spark, sf_dir).groupBy(F.date_format("dateTime", "yyyy-MM-dd").alias("day")).agg(*_ranks())


def q16(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """The same by channel and day, with the day's last minute."""
    return views.bid_ev(spark, sf_dir).groupBy("channel", F.date_format("dateTime", "yyyy-MM-dd").alias("day")).agg(F.max(F.date_format("dateTime", "HH:mm")).alias("minute"), *_ranks())


def q17(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Prices of an auction by day."""
    return (
        views.bid_ev(spark, sf_dir)
        .groupBy("auction", F.date_format("dateTime", "yyyy-MM-dd").alias("day"))
        .agg(*_ranks()[:4], F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.expr("sum(price) div count(price)").alias("avg_price"), F.sum("price").alias("sum_price"))
    )


def q18(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """A bidder's last bid on an auction; max_by combines before the shuffle, where a ranking would sort all rows."""
    last = views.bid_ev(spark, sf_dir).groupBy("bidder", "auction").agg(F.max_by(F.struct("price", "channel", "dateTime", "extra"), F.struct("dateTime", "event_id")).alias("last"))
    return last.select("auction", "bidder", "last.price", "last.channel", F.col("last.dateTime").alias("dt"), "last.extra")


def q19(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """The ten highest bids of an auction with their rank."""
    return win.top_n(views.bid_ev(spark, sf_dir), 10, ["auction"], F.desc("price"), F.asc("event_id")).select("auction", "bidder", "price", F.col("dateTime").alias("dt"), "rank_number")


def q20(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Bids with their auctions of one category."""
    a, b = views.auction(spark, sf_dir).where("category = 10").alias("a"), views.bid(spark, sf_dir).alias("b")
    return b.join(a, F.col("b.auction") == F.col("a.id")).select("b.auction", "b.bidder", "b.price", F.col("b.dateTime").alias("dt"), "a.seller", "a.category", "a.expires")


def q21(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Channel ids: fixed for hot channels, else read off the url."""
    named = F.lower("channel")
    found = regexp_extract_or_null(F.col("url"), CHANNEL_ID, 2)
    known = F.when(named == "apple", "0").when(named == "google", "1").when(named == "facebook", "2").when(named == "baidu", "3")
    return views.bid_ev(spark, sf_dir).select("auction", "bidder", "price", "channel", F.coalesce(known, found).alias("channel_id")).where(F.col("channel_id").isNotNull())


def q22(spark: SparkSession, sf_dir: views.Tables) -> DataFrame:
    """Directories of the url."""
    return views.bid_ev(spark, sf_dir).select("auction", "bidder", "price", "channel", *[split_index(F.col("url"), "/", k).alias(f"dir{k - 2}") for k in (3, 4, 5)])


QUERIES = {f.__name__: f for f in (q0, q1, q2, q3, q4, q5, q5_steady, q6, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22)}

_IN_TIME = f"(SELECT a.id, a.seller, a.category, a.initial, a.expires, a.dt AS adt, b.auction, b.bidder, b.price, b.dt FROM {AUCTION} a JOIN {BID} b ON a.id = b.auction AND b.dt BETWEEN a.dt AND a.expires)"
_WIN = f"(SELECT * FROM {_IN_TIME} QUALIFY row_number() OVER (PARTITION BY id ORDER BY price DESC, dt, bidder) = 1)"
_BANDS = {"total": "true", "rank1": f"price < {LOW}", "rank2": f"price >= {LOW} AND price < {HIGH}", "rank3": f"price >= {HIGH}"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}_bids" for n, c in _BANDS.items())
_DISTINCT = _COUNTS + ", " + ", ".join(f"count(DISTINCT {x}) FILTER (WHERE {c}) AS {n}_{w}" for w, x in (("bidders", "bidder"), ("auctions", "auction")) for n, c in _BANDS.items())
_DAY = "strftime(dt, '%Y-%m-%d') AS day"

ORACLE_SQL = {
    "q0": f"SELECT auction, bidder, price, dt, extra FROM {BID_EV}",
    "q1": f"SELECT auction, bidder, CAST({RATE} * price AS DECIMAL(23,3)) AS price, dt, extra FROM {BID_EV}",
    "q2": f"SELECT auction, price FROM {BID} WHERE auction % 123 = 0",
    "q3": f"SELECT p.name, p.city, p.state, a.id FROM {AUCTION} a JOIN {PERSON} p ON a.seller = p.id WHERE category = 10 AND state IN {STATES}",
    "q4": f"SELECT category, CAST(sum(final) // count(*) AS BIGINT) AS avg_price FROM (SELECT id, category, max(price) AS final FROM {_IN_TIME} GROUP BY id, category) GROUP BY category",
    "q5": f"WITH c AS (SELECT auction, starttime, count(*) AS num FROM {_hop_rows(10, 2, 'auction')} GROUP BY 1, 2), m AS (SELECT starttime, max(num) AS best FROM c GROUP BY 1) SELECT auction, starttime, starttime + INTERVAL 10 HOURS AS endtime, num FROM c JOIN m USING (starttime) WHERE num >= best",
    "q5_steady": f"SELECT auction, starttime, starttime + INTERVAL 10 HOURS AS endtime, count(*) AS num FROM {_hop_rows(10, 2, 'auction')} GROUP BY auction, starttime",
    "q6": f"SELECT seller, id, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price FROM {_WIN} WINDOW w AS (PARTITION BY seller ORDER BY dt, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)",
    "q7": f"SELECT auction, price, bidder, dt, extra FROM {BID_EV} b JOIN (SELECT time_bucket(INTERVAL 10 HOURS, dt, {EPOCH}) AS w, max(price) AS best FROM {BID_EV} GROUP BY 1) m ON b.price = m.best AND b.dt >= m.w AND b.dt < m.w + INTERVAL 10 HOURS",
    "q8": f"SELECT p.id, p.name, p.w AS starttime FROM (SELECT c_custkey AS id, c_name AS name, time_bucket(INTERVAL 30 DAYS, min(o_orderdate) - INTERVAL 20 DAYS, {EPOCH}) AS w FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) p JOIN (SELECT DISTINCT seller, time_bucket(INTERVAL 30 DAYS, dt, {EPOCH}) AS w FROM {AUCTION}) a ON p.id = a.seller AND p.w = a.w",
    "q9": f'SELECT id, category, seller, initial AS "initialBid", expires, auction, bidder, price, dt FROM {_WIN}',
    "q10": f"SELECT auction, bidder, price, dt AS at, extra, strftime(dt, '%Y-%m-%d') AS dt, strftime(dt, '%H:%M') AS hm FROM {BID_EV}",
    "q11": f"""WITH l AS (SELECT bidder, dt, CASE WHEN dt - lag(dt) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM {BID_EV} WINDOW w AS (PARTITION BY bidder ORDER BY dt)),
s AS (SELECT bidder, dt, sum(fresh) OVER (PARTITION BY bidder ORDER BY dt ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT bidder, min(dt) AS starttime, max(dt) + INTERVAL 6 HOURS AS endtime, count(*) AS bid_count FROM s GROUP BY bidder, k""",
    "q12": f"SELECT bidder, w AS starttime, w + INTERVAL 10 HOURS AS endtime, count(*) AS bid_count FROM (SELECT bidder, time_bucket(INTERVAL 10 HOURS, dt, {EPOCH}) AS w FROM {BID_EV}) GROUP BY bidder, w",
    "q13": f"SELECT auction, bidder, price, dt, value FROM {BID} b JOIN (SELECT i AS key, CAST(i AS VARCHAR) AS value FROM range(10000) r(i)) s ON b.auction % 10000 = s.key",
    "q14": f"SELECT auction, bidder, price, CASE WHEN hour(dt) BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour(dt) <= 6 OR hour(dt) >= 20 THEN 'nightTime' ELSE 'otherTime' END AS bid_time_type, dt, extra, CAST(coalesce(length(extra) - length(replace(extra, 'c', '')), 0) AS BIGINT) AS c_counts FROM (SELECT * REPLACE (CAST({RATE} * price AS DECIMAL(23,3)) AS price) FROM {BID_EV}) WHERE price > 1000 AND price < 50000000",
    "q15": f"SELECT {_DAY}, {_DISTINCT} FROM {BID_EV} GROUP BY 1",
    "q16": f"SELECT channel, {_DAY}, max(strftime(dt, '%H:%M')) AS minute, {_DISTINCT} FROM {BID_EV} GROUP BY 1, 2",
    "q17": f"SELECT auction, {_DAY}, {_COUNTS}, min(price) AS min_price, max(price) AS max_price, CAST(sum(price) // count(*) AS BIGINT) AS avg_price, CAST(sum(price) AS BIGINT) AS sum_price FROM {BID_EV} GROUP BY 1, 2",
    "q18": f"SELECT auction, bidder, price, channel, dt, extra FROM {BID_EV} QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY dt DESC, event_id DESC) = 1",
    "q19": f"SELECT auction, bidder, price, dt, CAST(row_number() OVER (PARTITION BY auction ORDER BY price DESC, event_id) AS INTEGER) AS rank_number FROM {BID_EV} QUALIFY rank_number <= 10",
    "q20": f"SELECT b.auction, b.bidder, b.price, b.dt, a.seller, a.category, a.expires FROM {BID} b JOIN {AUCTION} a ON b.auction = a.id WHERE a.category = 10",
    "q21": rf"""SELECT auction, bidder, price, channel, channel_id FROM (SELECT *, CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2' WHEN 'baidu' THEN '3' ELSE CASE WHEN regexp_matches(url, '{CHANNEL_ID}') THEN regexp_extract(url, '{CHANNEL_ID}', 2) END END AS channel_id FROM {BID_EV}) WHERE channel_id IS NOT NULL""",
    "q22": f"SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1, split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3 FROM {BID_EV}",
}
