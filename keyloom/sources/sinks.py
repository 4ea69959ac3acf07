"""Sinks: partitioned logs, discarded results, and files that a stream's batches overwrite idempotently."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a single machine takes a temporary
    folder; a cluster has no such."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: what is built on it neither computes it again nor
    depends on executors that held it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_log(df: DataFrame, path: str) -> None:
    """A CSV log partitioned by dt and hm; a _SUCCESS file tells that it is complete."""
    df.write.partitionBy("dt", "hm").mode("append").csv(path)


def discard(df: DataFrame) -> None:
    """Run df for nothing but its work."""
    df.write.format("noop").mode("overwrite").save()


def stream_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every batch of a stream under path/batch=<id>, for now available data.

    A batch that is done again after a failure overwrites its own files, so results are exactly once.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str = "update", ending: Callable[[], None] | None = None) -> DataFrame:
    """All rows that a stream emits for now available data, with the batch they came in.

    ending: called when all is read; it may add an end of the input to the stream's sources, from which the stream then
    goes on where it stopped.
    """
    spark = stream.sparkSession
    path, checkpoint = work_dir(spark, "stream"), work_dir(spark, "stream-checkpoint")
    stream_to_files(stream, path, checkpoint, mode).awaitTermination()
    if ending is not None:
        ending()
        stream_to_files(stream, path, checkpoint, mode).awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(path)


def measured(df: DataFrame) -> dict[str, float]:
    """Run df for nothing but its work and tell its rows, seconds and rows a second."""
    seen, began = Observation(), time.perf_counter()
    discard(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    seconds = time.perf_counter() - began
    return {"rows": seen.get["rows"], "seconds": seconds, "rows_per_second": seen.get["rows"] / seconds}


def write_log_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The partitioned log of a stream for now available data; the file sink's own log makes each batch count once."""
    return stream.writeStream.format("csv").partitionBy("dt", "hm").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
