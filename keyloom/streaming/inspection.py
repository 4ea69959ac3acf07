"""What a stopped stream has in its state: keys and entries, read from its checkpoint as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def state_entries(spark: SparkSession, checkpoint: str, state: str, operator: int = 0) -> DataFrame:
    """Rows of a named state: key, value (of maps and lists: their entries), partition_id."""
    return spark.read.format("statestore").option("stateVarName", state).option("operatorId", operator).load(checkpoint)


def state_keys(spark: SparkSession, checkpoint: str, state: str, operator: int = 0) -> DataFrame:
    """The keys that have a value in a named state."""
    return state_entries(spark, checkpoint, state, operator).select(F.col("key.*")).distinct()


def applied_to_all_keys(spark: SparkSession, checkpoint: str, state: str, function: Callable[[Column], Column], operator: int = 0) -> DataFrame:
    """(key's columns, value): a function of the value of a named state, for every key that has one."""
    return state_entries(spark, checkpoint, state, operator).select("key.*", function(F.col("value.value")).alias("value"))
