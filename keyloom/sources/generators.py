"""Seeded generators: every row is a function of its number, so any partitioning gives the same rows.

Batch generators number rows with range(); the same columns over a rate source make a stream. Random numbers
are hashes of (row number, seed, purpose).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The value domains of people, auctions and bids.
STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")
CITIES = ("Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne")
FIRST_NAMES = ("Peter", "Paul", "Luke", "John", "Saul", "Vicky", "Kate", "Julie", "Sarah", "Deiter", "Walter")
LAST_NAMES = ("Shultz", "Abrams", "Spencer", "White", "Bartels", "Walton", "Smith", "Jones", "Noris")
HOT_CHANNELS = ("Google", "Facebook", "Baidu", "Apple")


@dataclass(frozen=True)
class Config:
    """Proportions, hot ratios (1 - 1/ratio of the choices are hot), sizes in bytes and pace of auction events."""

    seed: int = 42
    people: int = 1
    auctions: int = 3
    bids: int = 46
    hot_sellers: int = 4
    hot_auctions: int = 2
    hot_bidders: int = 4
    hot_channels: int = 2
    in_flight: int = 100
    active_people: int = 1000
    person_bytes: int = 200
    auction_bytes: int = 500
    bid_bytes: int = 100
    events_per_second: int = 10_000
    out_of_order: int = 1
    base_millis: int = 1_436_918_400_000
    first_id: int = 1000
    first_category: int = 10
    categories: int = 5
    cold_channels: int = 10_000
    #: People or auctions of one hot batch.
    hot_batch: int = 100
    #: Ids that a choice may run ahead of those generated so far.
    lead: int = 10


class Draws:
    """Random columns of a row number."""

    def __init__(self, number: Column, seed: int):
        self.number, self.seed = number, seed

    def bits(self, purpose: str) -> Column:
        return F.xxhash64(self.number, F.lit(self.seed), F.lit(purpose))

    def below(self, n: Column | int, purpose: str) -> Column:
        return F.pmod(self.bits(purpose), F.lit(n) if isinstance(n, int) else n)

    def uniform(self, purpose: str) -> Column:
        """In [0, 1), of 53 bits."""
        return F.shiftrightunsigned(self.bits(purpose), 11).cast("double") / float(1 << 53)

    def one_of(self, values: tuple[str, ...], purpose: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(len(values), purpose) + 1).cast("int"))

    def price(self, purpose: str) -> Column:
        """Cents, log-uniform from 1 to a million units."""
        return F.round(F.pow(F.lit(10.0), self.uniform(purpose) * 6) * 100).cast("bigint")

    def word(self, length: int, purpose: str) -> Column:
        """A string of length letters."""
        parts = [F.conv(F.hex(self.bits(f"{purpose}{k}")), 16, 36) for k in range(-(-length // 10))]
        return F.lower(F.rpad(F.concat(*[F.substring(p, 1, 10) for p in parts]), length, "x"))

    def padding(self, used: Column, size: int, purpose: str) -> Column:
        """What fills a row of used bytes up to size, give or take a fifth; empty if it is full."""
        room = F.greatest(F.lit(size) - used, F.lit(0))
        length = (room * (self.uniform(purpose) * 0.4 + 0.8)).cast("int")
        return F.substring(F.repeat(F.md5(self.bits(purpose).cast("string")), (size * 12 // 10) // 32 + 1), F.lit(1), length)


def event_columns(number: Column, c: Config = Config()) -> list[Column]:
    """event_type (0 person, 1 auction, 2 bid), the three structs, of which one is set, and dateTime."""
    d = Draws(number, c.seed)
    total = c.people + c.auctions + c.bids
    epoch, offset = F.floor(number / total), number % total
    kind = F.when(offset < c.people, 0).when(offset < c.people + c.auctions, 1).otherwise(2)

    last_person = epoch * c.people + F.least(offset, F.lit(c.people - 1))
    in_epoch = F.when(offset < c.people, -1).otherwise(F.least(offset - c.people, F.lit(c.auctions - 1)))
    last_auction = epoch * c.auctions + in_epoch
    known = F.least(last_person + 1, F.lit(c.active_people))
    any_person = lambda purpose: last_person + 1 - known + d.below(known + c.lead, purpose)
    oldest = F.greatest(last_auction - c.in_flight, F.lit(0))
    any_auction = oldest + d.below(F.greatest(last_auction - oldest, F.lit(0)) + 1 + c.lead, "auction")
    hot = lambda ratio, purpose: d.below(ratio, purpose) > 0
    batch = lambda x: F.floor(F.greatest(x, F.lit(0)) / c.hot_batch) * c.hot_batch

    # In groups of out_of_order events, times are shuffled by a multiplication modulo the group.
    shuffled = F.floor(number / c.out_of_order) * c.out_of_order + (number * 953) % c.out_of_order
    millis = lambda n: F.lit(c.base_millis) + F.floor(n * 1000 / c.events_per_second)
    time = F.timestamp_millis(millis(shuffled))
    horizon = F.greatest(F.lit(2 * 1000 * c.in_flight * total // (c.auctions * c.events_per_second)), F.lit(1))

    name = F.concat_ws(" ", d.one_of(FIRST_NAMES, "first"), d.one_of(LAST_NAMES, "last"))
    email = F.concat(d.word(7, "mailbox"), F.lit("@"), d.word(5, "domain"), F.lit(".com"))
    card = F.concat_ws(" ", *[F.lpad(d.below(10_000, f"card{k}").cast("string"), 4, "0") for k in range(4)])
    city, state = d.one_of(CITIES, "city"), d.one_of(STATES, "state")
    size = lambda *x: sum((F.length(v) for v in x), F.lit(8))
    person = F.struct(
        (last_person + c.first_id).cast("bigint").alias("id"), name.alias("name"), email.alias("emailAddress"), card.alias("creditCard"), city.alias("city"), state.alias("state"),
        time.alias("dateTime"), d.padding(size(name, email, card, city, state), c.person_bytes, "person").alias("extra"),
    )
    seller = F.when(hot(c.hot_sellers, "hot seller"), batch(last_person)).otherwise(any_person("seller")) + c.first_id
    initial = d.price("initial")
    auction = F.struct(
        (last_auction + c.first_id).cast("bigint").alias("id"), d.word(20, "item").alias("itemName"), d.word(100, "about").alias("description"), initial.alias("initialBid"),
        (initial + d.price("reserve")).alias("reserve"), time.alias("dateTime"), F.timestamp_millis(millis(shuffled) + 1 + d.below(horizon, "open")).alias("expires"),
        seller.cast("bigint").alias("seller"), (d.below(c.categories, "category") + c.first_category).alias("category"), d.padding(F.lit(168), c.auction_bytes, "auction").alias("extra"),
    )
    cold = d.below(c.cold_channels, "cold channel")
    is_hot = hot(c.hot_channels, "channel kind")
    channel = F.when(is_hot, d.one_of(HOT_CHANNELS, "hot channel")).otherwise(F.concat(F.lit("channel-"), cold.cast("string")))
    path = F.substring(F.md5(channel), 1, 15)
    url = F.concat(F.lit("https://www.example.com/"), F.substring(path, 1, 5), F.lit("/"), F.substring(path, 6, 5), F.lit("/"), F.substring(path, 11, 5), F.lit("/item.htm?query=1"))
    tagged = F.when(~is_hot & (cold % 10 > 0), F.concat(url, F.lit("&channel_id="), cold.cast("string"))).otherwise(url)
    # Bidder ids are offset twice, so that they are a space of their own.
    bidder = F.when(hot(c.hot_bidders, "hot bidder"), batch(last_person) + 1).otherwise(any_person("bidder")) + 2 * c.first_id
    bid = F.struct(
        (F.when(hot(c.hot_auctions, "hot auction"), batch(last_auction)).otherwise(any_auction) + c.first_id).cast("bigint").alias("auction"), bidder.cast("bigint").alias("bidder"),
        d.price("price").alias("price"), channel.alias("channel"), tagged.alias("url"), time.alias("dateTime"), d.padding(F.lit(32), c.bid_bytes, "bid").alias("extra"),
    )
    only = lambda k, x, n: F.when(kind == k, x).alias(n)
    return [kind.alias("event_type"), only(0, person, "person"), only(1, auction, "auction"), only(2, bid, "bid"), time.alias("dateTime")]


def auction_events(spark: SparkSession, n: int, config: Config = Config(), first: int = 0) -> DataFrame:
    """Events first .. first + n - 1."""
    return spark.range(first, first + n).select(*event_columns(F.col("id"), config))


def auction_event_stream(spark: SparkSession, config: Config = Config(), rows_per_batch: int = 10_000) -> DataFrame:
    """The same events as a stream of batches of rows_per_batch, with a watermark of four seconds; restarts go on from the checkpoint."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", spark.sparkContext.defaultParallelism).load()
    return numbers.select(*event_columns(F.col("value"), config)).withWatermark("dateTime", "4 seconds")


def people(events: DataFrame) -> DataFrame:
    return events.where("event_type = 0").select("person.*")


def auctions(events: DataFrame) -> DataFrame:
    return events.where("event_type = 1").select("auction.*")


def bids(events: DataFrame) -> DataFrame:
    return events.where("event_type = 2").select("bid.*")


def zipf_ranks(df: DataFrame, uniform: Column, keys: int, skew: float, name: str = "key") -> DataFrame:
    """df with name: Zipf ranks 0 .. keys - 1 by inverting the distribution at uniform numbers.

    Every task builds the distribution (keys numbers) from its rule; nothing is sent. skew 0 is uniform.
    """
    if skew <= 0:
        return df.withColumn(name, F.floor(uniform * keys).cast("bigint"))
    rows = df.withColumn(name, uniform)
    schema = T.StructType([*df.schema, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heights = 1.0 / np.arange(1, keys + 1) ** skew
        upto = np.cumsum(heights / heights.sum())
        for b in batches:
            ranks = np.minimum(np.searchsorted(upto, b.column(b.num_columns - 1).to_numpy()), keys - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ranks, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def words(spark: SparkSession, n: int, keys: int = 1_000_000, skew: float = 1.1, seed: int = 42) -> DataFrame:
    """word, count (1): words word_<rank>, by Zipf or uniform."""
    ranked = zipf_ranks(spark.range(n), Draws(F.col("id"), seed).uniform("word"), keys, skew, "rank")
    return ranked.select(F.concat(F.lit("word_"), F.col("rank").cast("string")).alias("word"), F.lit(1).cast("bigint").alias("count"))


def keyed_events(spark: SparkSession, n: int, keys: int, kinds: int = 4, skew: float = 0.0, batch: int = 16, seed: int = 17, again: float = 0.38) -> DataFrame:
    """key, auxKey, value (1 to 1000), eventType (below kinds), sequence. A share `again` of the rows takes the
    key of one of the rows shortly before it, so keys are active in spells."""
    window = max(64, min(4096, max(batch * 16, keys // 1024)))
    d = Draws(F.col("id"), seed)
    source = F.when(d.uniform("again") < again, F.greatest(F.col("id") - 1 - d.below(window, "back"), F.lit(0))).otherwise(F.col("id"))
    rows = spark.range(n).withColumn("__source", source)
    drawn = zipf_ranks(rows, Draws(F.col("__source"), seed).uniform("key"), keys, skew)
    return drawn.select(
        "key", F.pmod(F.col("key") * 17 + d.below(keys, "aux"), F.lit(keys)).alias("auxKey"), (d.below(1000, "value") + 1).alias("value"),
        d.below(kinds, "kind").cast("int").alias("eventType"), F.col("id").alias("sequence"),
    )


def drifting_keys(spark: SparkSession, n: int, keys: int, hot_keys: int, hot_percent: int = 80, interval: int = 100_000, step: int = 1000, seed: int = 7) -> DataFrame:
    """joinKey, eventTime, sequence: hot_percent of the rows go to hot_keys adjacent keys, whose place moves by
    step after every interval rows."""
    d = Draws(F.col("id"), seed)
    base = (F.floor(F.col("id") / interval) * step) % keys
    hot = F.pmod(base + d.below(hot_keys, "hot"), F.lit(keys))
    key = F.when(d.below(100, "side") < hot_percent, hot).otherwise(d.below(keys, "cold"))
    return spark.range(n).select(key.cast("bigint").alias("joinKey"), F.col("id").alias("eventTime"), F.col("id").alias("sequence"))


def side_input(spark: SparkSession, n: int = 10_000) -> DataFrame:
    """key, value: n rows i, i."""
    return spark.range(n).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value"))
