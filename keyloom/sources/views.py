"""People, auctions and bids bound to the driver tables.

`bid`/`auction`/`person` come from the order tables; `bid_ev` from the event stream, for windows.
Only the columns asked for are read: every view is a plain projection over a Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables come from: a folder of Parquet files, or what opens a table by name (as a stream, say).
Tables = str | Callable[[SparkSession, str], DataFrame]
#: An auction stays open this long after its order date.
OPEN_DAYS = 730
# The hot channels and the address of every bid.
HOT_CHANNELS = ("Apple", "Google", "Facebook", "Baidu")
URL = "https://www.example.com/a/b/c/item.htm?query=1"


def table(spark: SparkSession, sf_dir: Tables, name: str) -> DataFrame:
    return sf_dir(spark, name) if callable(sf_dir) else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person(spark: SparkSession, sf_dir: Tables) -> DataFrame:
    """id, name, city, state, extra."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "city", "state", F.col("c_mktsegment").alias("extra"))


def auction(spark: SparkSession, sf_dir: Tables) -> DataFrame:
    """id, seller, category, dateTime, expires, initialBid."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("seller"),
        (10 + F.col("o_orderkey") % 5).alias("category"),
        F.col("o_orderdate").alias("dateTime"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {OPEN_DAYS} DAYS")).alias("expires"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("initialBid"),
    )


def bid(spark: SparkSession, sf_dir: Tables) -> DataFrame:
    """auction, bidder, price (cents), channel, dateTime."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("auction"),
        F.col("l_suppkey").alias("bidder"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.col("l_returnflag").alias("channel"),
        F.col("l_shipdate").alias("dateTime"),
    )


def bid_ev(spark: SparkSession, sf_dir: Tables) -> DataFrame:
    """event_id, auction, bidder, price, channel, url, dateTime, extra: bids read off the event stream.

    Half of the bids use one of four hot channels; nine in ten of the others' urls name a channel id.
    """
    e = table(spark, sf_dir, "events")
    hot = F.element_at(F.array(*[F.lit(c) for c in HOT_CHANNELS]), (F.expr("event_id div 2") % 4 + 1).cast("int"))
    number = F.col("event_id") % 1000
    return e.select(
        "event_id",
        (F.col("event_id") % 100).alias("auction"),
        F.col("user_id").alias("bidder"),
        F.round(F.col("value") * 100).cast("bigint").alias("price"),
        F.when(F.col("event_id") % 2 == 0, hot).otherwise(F.concat(F.lit("channel-"), number.cast("string"))).alias("channel"),
        F.concat(F.lit(URL), F.when((F.col("event_id") % 2 == 1) & (F.col("event_id") % 20 != 1), F.concat(F.lit("&channel_id="), number.cast("string"))).otherwise("")).alias("url"),
        F.col("ts").alias("dateTime"),
        F.col("props").alias("extra"),
    )


def people_since(spark: SparkSession, sf_dir: Tables) -> DataFrame:
    """id, name, dateTime: customers, taken to have come 20 days before their first order."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_orderdate") - F.expr("INTERVAL 20 DAYS")).alias("dateTime"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(first, customer.c_custkey == first.o_custkey).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "dateTime")
