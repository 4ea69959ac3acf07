"""Streaming twins: the queries of the suite over a stream of the same files, drained and read back.

What is compared with the batch oracle is the final state: for outputs in update mode each key's last row. Twins that
emit what event time has closed end their input: once all is read, a row of the time END is added to every timed
source, which lifts the watermark over all that is open, as the end of a bounded source does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.running import running
from keyloom.plans import auctions, patterns
from keyloom.sources import views
from keyloom.sources.generators import side_input
from keyloom.sources.sinks import drained, stream_to_files, work_dir
from keyloom.streaming import processors as P

DELAY, CACHE = "4 seconds", "20 MINUTES"
CACHE_SECONDS = 20 * 60
PIECE_SECONDS = 6 * CACHE_SECONDS
#: The time of the row that ends an input; later than any event.
END = "2200-01-01 00:00:00"
#: The event-time column of each streamed table.
TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream. Timestamps get a time zone (UTC), which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return raw.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema])


def streamed(sf_dir: str, static: tuple[str, ...] = ("nation", "region")) -> views.Tables:
    """Tables for a plan: streams, with the suite's watermark where they have event time; static ones are read whole."""

    def opened(spark: SparkSession, name: str) -> DataFrame:
        if name in static:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows = stream(spark, sf_dir, name)
        return rows.withWatermark(TIMES[name], DELAY) if name in TIMES else rows

    return opened


class Ended:
    """Tables as streamed() gives them, with an end: ending() writes it to the folders that the streams read besides."""

    def __init__(self, spark: SparkSession, sf_dir: str, static: tuple[str, ...] = ("nation", "region")):
        self.spark, self.sf_dir, self.static, self.path = spark, sf_dir, static, work_dir(spark, "stream-end")
        self.schemas: dict[str, T.StructType] = {}

    def __call__(self, spark: SparkSession, name: str) -> DataFrame:
        if name in self.static or name not in TIMES:
            return streamed(self.sf_dir, self.static)(spark, name)
        return self.timed(stream(spark, self.sf_dir, name), name, TIMES[name])

    def timed(self, rows: DataFrame, name: str, time: str) -> DataFrame:
        """A stream with its end and the suite's watermark."""
        self.schemas[name] = T.StructType([T.StructField(f.name, f.dataType, True, {"time": f.name == time}) for f in rows.schema])
        self.spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{self.path}/{name}")
        end = self.spark.readStream.schema(rows.schema).parquet(f"{self.path}/{name}")
        return rows.unionByName(end).withWatermark(time, DELAY)

    def ending(self) -> None:
        """Whole numbers of an end are negative, of every table others: joins drop null keys before a watermark sees the row."""
        for k, (name, schema) in enumerate(self.schemas.items()):
            value = lambda f: END if f.metadata["time"] else -1 - k if isinstance(f.dataType, T.IntegralType) else None  # noqa: B023, E731
            self.spark.range(1).select(*[F.lit(value(f)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{self.path}/{name}")

    def drained(self, rows: DataFrame) -> DataFrame:
        return naive(drained(rows, "append", self.ending).drop("batch"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as bids."""
    return views.bid_ev(spark, streamed(sf_dir))


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the latest batch for every key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")


def naive(df: DataFrame) -> DataFrame:
    """df with its timestamps as the batch tables have them, without a time zone."""
    return df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if kind == "timestamp" else F.col(n) for n, kind in df.dtypes])


def appended(plan: Callable[[SparkSession, views.Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The twin of a batch plan that streams as it is: the same plan over streamed tables, drained."""

    def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
        return naive(drained(plan(spark, streamed(sf_dir)), "append").drop("batch"))

    twin.__doc__ = plan.__doc__
    return twin


def ended(plan: Callable[[SparkSession, views.Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """As appended, for plans that emit what event time has closed: the input has an end."""

    def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Ended(spark, sf_dir)
        return tables.drained(plan(spark, tables))

    twin.__doc__ = plan.__doc__
    return twin


def updated(plan: Callable[[SparkSession, views.Tables], DataFrame], *keys: str) -> Callable[[SparkSession, str], DataFrame]:
    """The same for plans that end in an aggregate: the last state of every key."""

    def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
        return naive(last_of(drained(plan(spark, streamed(sf_dir))), *keys))

    twin.__doc__ = plan.__doc__
    return twin


def s_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hottest auctions of each sliding window: counts, their maximum by window, joined on the window."""
    tables = Ended(spark, sf_dir)
    counts = lambda: views.bid_ev(spark, tables).groupBy(F.window("dateTime", auctions.HOP, auctions.SLIDE), "auction").agg(F.count("*").alias("num"))
    best = counts().groupBy("window").agg(F.max("num").alias("best")).withColumnRenamed("window", "w")
    rows = counts().join(best, F.col("window") == F.col("w")).where("num >= best")
    return tables.drained(rows.select("auction", F.col("window.start").alias("starttime"), F.col("window.end").alias("endtime"), "num"))


def s_q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest bids of each tumbling window: the bids of each price, then those of the highest, by window."""
    tables = Ended(spark, sf_dir)
    bid = F.struct("auction", "price", "bidder", F.col("dateTime").cast("timestamp_ntz").alias("dt"), "extra")
    prices = views.bid_ev(spark, tables).groupBy(F.window("dateTime", auctions.TUMBLE), "price").agg(F.collect_list(bid).alias("bids"))
    best = prices.groupBy("window").agg(F.max_by("bids", "price").alias("bids"))
    return tables.drained(best.select(F.explode("bids").alias("bid")).select("bid.*"))


def s_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who opened an auction in the window in which they came: two windowed streams joined."""
    tables, path = Ended(spark, sf_dir), work_dir(spark, "people")
    views.people_since(spark, sf_dir).withColumn("dateTime", F.col("dateTime").cast("timestamp")).write.parquet(path)
    people = tables.timed(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "people", "dateTime")
    p = people.groupBy(F.window("dateTime", auctions.NEWCOMERS).alias("w"), "id", "name").agg(F.count("*").alias("n"))
    a = views.auction(spark, tables).groupBy(F.window("dateTime", auctions.NEWCOMERS).alias("v"), "seller").agg(F.count("*").alias("m"))
    rows = p.join(a, (p.id == a.seller) & (p.w == a.v))
    return tables.drained(rows.select("id", "name", F.col("w.start").alias("starttime")))


def closed(spark: SparkSession, tables: views.Tables, *rest: str) -> DataFrame:
    """opened, best (price, dt, bidder and rest of an auction, id first) for every auction with bids, once event time has
    passed its end: interval join of two streams, then the best bid (highest, then earliest, then of the smallest bidder).

    The condition spells the end out, so that the join tells how long it holds auctions: an auction's group then closes
    only when no bid within its time can follow. Both states are Spark's own and take no call per key to Python.
    """
    P.in_rocksdb(spark)
    a, b = views.auction(spark, tables).alias("a"), views.bid(spark, tables).alias("b")
    rows = a.join(b, F.expr(f"a.id = b.auction AND b.dateTime >= a.dateTime AND b.dateTime <= a.dateTime + INTERVAL {views.OPEN_DAYS} DAYS"))
    best = F.min(F.struct((-F.col("b.price")).alias("down"), F.col("b.dateTime").alias("dt"), "b.bidder", *[f"a.{c}" for c in rest])).alias("best")
    rows = rows.groupBy("a.id", F.col("a.dateTime").alias("opened")).agg(best)
    return rows.select("opened", "id", (-F.col("best.down")).alias("price"), "best.dt", "best.bidder", *[f"best.{c}" for c in rest])


def s_q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning bid of every auction, once it has closed."""
    tables = Ended(spark, sf_dir)
    rows = closed(spark, tables, "category", "seller", "initialBid", "expires")
    return tables.drained(rows.select("id", "category", "seller", "initialBid", "expires", F.col("id").alias("auction"), "bidder", "price", "dt"))


def _ranks_by_sets() -> list[Column]:
    """The price bands' counts where a stream has no exact distinct count: sizes of sets."""
    distinct = lambda cond, column: F.size(F.collect_set(F.when(cond, F.col(column)))).cast("bigint")
    return [F.count_if(cond).alias(f"{n}_bids") for n, cond in auctions.bands().items()] + [distinct(cond, x).alias(f"{n}_{what}") for what, x in (("bidders", "bidder"), ("auctions", "auction")) for n, cond in auctions.bands().items()]


def _q15(spark: SparkSession, tables: views.Tables) -> DataFrame:
    """Bids, bidders and auctions of a day by price band."""
    return views.bid_ev(spark, tables).groupBy(F.date_format("dateTime", "yyyy-MM-dd").alias("day")).agg(*_ranks_by_sets())


def _q16(spark: SparkSession, tables: views.Tables) -> DataFrame:
    """The same by channel and day, with the day's last minute."""
    return views.bid_ev(spark, tables).groupBy("channel", F.date_format("dateTime", "yyyy-MM-dd").alias("day")).agg(F.max(F.date_format("dateTime", "HH:mm")).alias("minute"), *_ranks_by_sets())


def s_q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-static lookup join."""
    b, side = bids(spark, sf_dir), side_input(spark)
    rows = b.join(F.broadcast(side), b.auction % 10_000 == side.key).select("auction", "bidder", "price", F.col("dateTime").alias("dt"), "value")
    return naive(drained(rows, "append").drop("batch"))


def s_q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bid of a bidder on an auction by max_by, which streams where a ranking does not."""
    last = bids(spark, sf_dir).groupBy("bidder", "auction").agg(F.max_by(F.struct("price", "dateTime", "extra"), F.struct("dateTime", "event_id")).alias("last"))
    rows = drained(last.select("bidder", "auction", "last.price", F.col("last.dateTime").alias("dt"), "last.extra"))
    return naive(last_of(rows, "bidder", "auction"))


def s_q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest bids of an auction by a stateful processor."""
    rows = bids(spark, sf_dir).select("auction", F.col("event_id").alias("id"), F.col("price").alias("score"))
    out = drained(P.processed(rows, "auction", P.TopN, "key long, id long, score long, rank_number long"))
    return last_of(out, "key", "rank_number").select(F.col("key").alias("auction"), F.col("id").alias("event_id"), F.col("score").alias("price"), "rank_number")


def s_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest bid of every closed auction, then, as a stream of its own, the average by category."""
    tables, path = Ended(spark, sf_dir), work_dir(spark, "closed")
    tables.drained(closed(spark, tables, "category").select("category", "price")).write.parquet(path)
    total = spark.readStream.schema("category long, price long").parquet(path).groupBy("category").agg(F.expr("sum(price) div count(price)").alias("avg_price"))
    return last_of(drained(total), "category")


def s_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average price of a seller's last eleven closed auctions: winners as their auctions close, then by seller."""
    tables, path = Ended(spark, sf_dir), work_dir(spark, "winners")
    tables.drained(closed(spark, tables, "seller").select("seller", "id", "price", F.unix_micros("dt").alias("micros"))).write.parquet(path)
    sellers = Ended(spark, sf_dir)
    winners = spark.readStream.schema("seller long, id long, price long, micros long").parquet(path).withColumn("at", F.timestamp_micros("micros"))
    timed = sellers.timed(winners, "winners", "at").where(F.col("at") < F.lit(END).cast("timestamp"))
    return sellers.drained(last_closed(timed))


def last_closed(winners: DataFrame) -> DataFrame:
    """seller, id, avg_price from a stream of winners (seller, id, price, micros; a watermark is on it), by buckets of sellers."""
    bucket = F.when(F.col("seller").isNull(), -1).otherwise(F.pmod(F.xxhash64("seller"), F.lit(P.LastClosed.BUCKETS))).alias("bucket")
    # The row's time stays, since timeouts need its watermark.
    rows = winners.select(bucket, F.coalesce("seller", F.lit(0)).alias("seller"), "id", "price", "micros", "at")
    out = P.grouped(rows, "bucket", P.LastClosed(views.OPEN_DAYS * 86_400_000), "bucket long, seller long, id long, total long, n long", "EventTimeTimeout")
    return out.select(F.when(F.col("bucket") >= 0, F.col("seller")).alias("seller"), "id", F.expr("total div n").alias("avg_price"))


def multiple_inputs(spark: SparkSession, policy: str = "min") -> None:
    """How a stream of several timed inputs takes its watermark: from the slowest of them ('min', so that none of their rows
    is late for another's sake), or from the fastest ('max'). Set before the stream starts."""
    if policy not in ("min", "max"):
        raise ValueError("the policy is min or max")
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)


def s_cep_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sudden drops of a bidder's prices, by a processor that matches rows once event time has passed them."""
    tables = Ended(spark, sf_dir)
    pattern, _ = patterns.PATTERNS["cep_q3"]
    # Without the end; the condition names the time, so that it comes after the watermark, which the timeouts need in the rows.
    rows = views.bid_ev(spark, tables).where(F.col("dateTime") < F.lit(END).cast("timestamp")).select("bidder", F.unix_micros("dateTime").alias("micros"), "event_id", "price", "dateTime")
    out = P.grouped(rows, "bidder", P.Drops(pattern), "bidder long, micros long, drop_diff long", "EventTimeTimeout")
    return naive(tables.drained(out).select("bidder", F.timestamp_micros("micros").alias("drop_time"), "drop_diff"))


def s_stateful_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value read and written again for every event; keys pass through."""
    e = stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sequence"))
    return drained(P.grouped(e, "user_id", P.Touch(), "key long, sequence long"), "append").drop("batch")


def s_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count per user for every event."""
    e = stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sequence"))
    return drained(P.processed(e, "user_id", P.RunningCount, "key long, sequence long, running long", "append"), "append").drop("batch")


def s_two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stream join by keyed state."""
    e = stream(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"), F.col("event_id").alias("sequence"))
    out = P.grouped(e, "user_id", P.TwoSides(), "key long, side string, sequence long, value long")
    return drained(out, "append").drop("batch")


def s_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that event time has left idle, by event-time timers."""
    tables = Ended(spark, sf_dir)
    rows = tables(spark, "events").where(F.col("ts") < F.lit(END).cast("timestamp")).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    return tables.drained(P.processed(rows, "user_id", P.Idle, "key long, last long", "append", "EventTime"))


def _two_sided(e: DataFrame) -> DataFrame:
    """Events of even numbers and, within twenty minutes before or after, odd ones of the same user; an event
    that comes twice counts once."""
    key = F.col("user_id")
    left = e.where("event_id % 2 = 0").select(key.alias("user"), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    right = e.where("event_id % 2 = 1").select(key.alias("right_user"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    if e.isStreaming:
        P.in_rocksdb(e.sparkSession)
        left, right = left.dropDuplicatesWithinWatermark(["left_id"]), right.dropDuplicatesWithinWatermark(["right_id"])
    else:
        left, right = left.dropDuplicates(["left_id"]), right.dropDuplicates(["right_id"])
    # Times in pieces of six times the cache's length: a right event meets the pieces that its cache reaches into, one or
    # two, so that no user is one task's work and few events are held twice.
    piece = lambda c: F.floor(c / PIECE_SECONDS)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    left = left.withColumn("piece", piece(seconds("left_ts")))
    # A second more before and after: seconds leave off what is behind the point.
    reach = CACHE_SECONDS + 1
    right = right.withColumn("right_piece", F.explode(F.sequence(piece(seconds("right_ts") - reach), piece(seconds("right_ts") + reach))))
    near = F.expr(f"user = right_user AND piece = right_piece AND right_ts >= left_ts - INTERVAL {CACHE} AND right_ts <= left_ts + INTERVAL {CACHE}")
    return left.join(right, near).select("user", "left_id", "right_id")


def client_join(spark: SparkSession, tables: views.Tables) -> DataFrame:
    """Two streams joined by key within the time that either side is cached."""
    return _two_sided(views.table(spark, tables, "events"))


def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts of words (event types): 5 hours every 12 minutes, 25 windows a row."""
    e = views.table(spark, sf_dir, "events")
    counts = e.groupBy(F.window("ts", "5 hours", "12 minutes").alias("w"), F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return counts.select("word", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "n")


def running_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of every word, batch; words are few, so their rows run in blocks of sequence numbers."""
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("sequence"), F.lit(0).alias("branch"))
    return running(rows, {"running": "1"}).select(F.col("key").alias("word"), F.col("sequence").alias("event_id"), "running")


def processing_windows(rows: DataFrame, keys: list[str], size: str, slide: str | None = None, clock: str | None = None) -> DataFrame:
    """Counts by keys and window of processing time (tumbling, or sliding with a slide), in a stream or a batch.

    A stream reads the clock once a batch; a window is over when a later batch has begun after it. clock names a column
    (in a stream, one with a watermark) that stands in for the clock, so that a result can be told beforehand.
    """
    if clock is None:
        clock, rows = "clock", rows.withColumn("clock", F.current_timestamp())
        rows = rows.withWatermark(clock, "0 seconds") if rows.isStreaming else rows
    window = F.window(clock, size, slide) if slide else F.window(clock, size)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "n")


def s_q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids per bidder and tumbling window of processing time, with the event's time as the clock."""
    tables = Ended(spark, sf_dir)
    out = processing_windows(views.bid_ev(spark, tables), ["bidder"], auctions.TUMBLE, clock="dateTime")
    return tables.drained(out).withColumnRenamed("n", "bid_count")


def s_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts of words by processing time, with the event's time as the clock."""
    tables = Ended(spark, sf_dir)
    rows = tables(spark, "events").select(F.col("event_type").alias("word"), "ts")
    return tables.drained(processing_windows(rows, ["word"], "5 hours", "12 minutes", "ts"))


STREAMED = ("q0", "q1", "q2", "q3", "q10", "q14", "q20", "q21", "q22")
OWN = (s_q4, s_q5, s_q6, s_q7, s_q8, s_q9, s_q13, s_q12, s_q18, s_q19, s_word_windows, s_cep_q3, s_running_count, s_two_sides, s_idle, s_stateful_map)
QUERIES = {
    **{f"stream_{n}": appended(getattr(auctions, n)) for n in STREAMED},
    "stream_q5_steady": updated(auctions.q5_steady, "auction", "starttime", "endtime"),
    "stream_q11": ended(auctions.q11),
    "stream_q15": updated(_q15, "day"),
    "stream_q16": updated(_q16, "channel", "day"),
    "stream_q17": updated(auctions.q17, "auction", "day"),
    **{f"stream_{f.__name__[2:]}": f for f in OWN},
    "stream_client_join": appended(client_join),
    "client_join": client_join,
    "word_windows": word_windows,
    "running_words": running_words,
}
_NEAR = f"SELECT a.user_id AS user, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND b.ts BETWEEN a.ts - INTERVAL {CACHE} AND a.ts + INTERVAL {CACHE}"
_BE = auctions.BID_EV
_WORDS = f"SELECT word, s AS starttime, s + INTERVAL 5 HOURS AS endtime, count(*) AS n FROM (SELECT event_type AS word, time_bucket(INTERVAL 12 MINUTES, ts, {auctions.EPOCH}) - to_minutes(12 * k) AS s FROM events, (SELECT unnest(range(25)) AS k)) GROUP BY word, s"
ORACLE_SQL = {
    **{f"stream_{n}": auctions.ORACLE_SQL[n] for n in (*STREAMED, "q4", "q5", "q5_steady", "q6", "q7", "q8", "q9", "q11", "q12", "q15", "q16", "q17")},
    "stream_q13": f"SELECT auction, bidder, price, dt, CAST(auction % 10000 AS VARCHAR) AS value FROM {_BE}",
    "stream_q18": f"SELECT bidder, auction, price, dt, extra FROM {_BE} QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY dt DESC, event_id DESC) = 1",
    "stream_q19": f"SELECT auction, event_id, price, row_number() OVER (PARTITION BY auction ORDER BY price DESC, event_id) AS rank_number FROM {_BE} QUALIFY rank_number <= 10",
    "client_join": _NEAR,
    "stream_client_join": _NEAR,
    "stream_running_count": "SELECT user_id AS key, event_id AS sequence, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events",
    "stream_cep_q3": patterns.ORACLE_SQL["cep_q3"],
    "stream_stateful_map": "SELECT user_id AS key, event_id AS sequence FROM events",
    "stream_idle": "SELECT user_id AS key, max(epoch_us(ts)) // 1000 AS last FROM events GROUP BY 1",
    "word_windows": _WORDS,
    "stream_word_windows": _WORDS,
    "running_words": "SELECT event_type AS word, event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS running FROM events",
}
