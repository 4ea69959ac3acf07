"""Files and queues as sources: side tables, lines of text, and JSON envelopes of events on Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


LONG, STRING, TIME = T.LongType(), T.StringType(), T.TimestampType()
PERSON = _struct(id=LONG, name=STRING, emailAddress=STRING, creditCard=STRING, city=STRING, state=STRING, dateTime=TIME, extra=STRING)
AUCTION = _struct(id=LONG, itemName=STRING, description=STRING, initialBid=LONG, reserve=LONG, dateTime=TIME, expires=TIME, seller=LONG, category=LONG, extra=STRING)
BID = _struct(auction=LONG, bidder=LONG, price=LONG, channel=STRING, url=STRING, dateTime=TIME, extra=STRING)
EVENT = _struct(event_type=T.IntegerType(), person=PERSON, auction=AUCTION, bid=BID)


def side_table(spark: SparkSession, path: str) -> DataFrame:
    """key, value rows of CSV files; a line that doesn't fit the schema is an error."""
    return spark.read.schema("key long, value string").option("mode", "FAILFAST").csv(path)


def text_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines (value) of text files, read in splits; a stream goes on with new files."""
    return (spark.readStream if streaming else spark.read).text(path)


def tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """word: the words of every line, lower-cased."""
    return lines.select(F.explode(F.split(F.lower(column), r"\W+")).alias("word")).where("word != ''")


def to_envelopes(events: DataFrame) -> DataFrame:
    """value: events as JSON strings, as a queue's sink wants them."""
    return events.select(F.to_json(F.struct("event_type", "person", "auction", "bid"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("value"))


def from_envelopes(raw: DataFrame) -> DataFrame:
    """Events with their time, from JSON strings (or bytes) in value; what is no event is left out."""
    event = F.from_json(F.col("value").cast("string"), EVENT, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})
    rows = raw.select(event.alias("e")).where("e.event_type IS NOT NULL").select("e.*")
    kind = F.col("event_type")
    time = F.when(kind == 0, F.col("person.dateTime")).when(kind == 1, F.col("auction.dateTime")).otherwise(F.col("bid.dateTime"))
    return rows.withColumn("dateTime", time)


def kafka_options(servers: str, topic: str, source: bool) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers} | ({"subscribe": topic, "startingOffsets": "earliest"} if source else {"topic": topic})


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events of a topic from its beginning, as a stream with the suite's watermark. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, True)).load()
    return from_envelopes(raw).withWatermark("dateTime", "4 seconds")


def write_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start a query that sends streamed events to a topic. Needs Spark's Kafka package."""
    return to_envelopes(events).writeStream.format("kafka").options(**kafka_options(servers, topic, False)).option("checkpointLocation", checkpoint).start()
