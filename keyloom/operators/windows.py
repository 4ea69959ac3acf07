"""Time windows, ranking and interval joins, as the query suite uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumble(df: DataFrame, time: str, size: str, *keys: str) -> "GroupedTumble":
    return GroupedTumble(df, F.window(time, size), keys)


def hop(df: DataFrame, time: str, size: str, slide: str, *keys: str) -> "GroupedTumble":
    return GroupedTumble(df, F.window(time, size, slide), keys)


def session(df: DataFrame, time: str, gap: str, *keys: str) -> "GroupedTumble":
    return GroupedTumble(df, F.session_window(time, gap), keys)


class GroupedTumble:
    """Rows grouped by a time window and keys; agg() returns keys, starttime, endtime and the aggregates."""

    def __init__(self, df: DataFrame, window: Column, keys: tuple[str, ...]):
        self.df, self.window, self.keys = df, window.alias("__w"), keys

    def agg(self, *aggregates: Column) -> DataFrame:
        out = self.df.groupBy(self.window, *self.keys).agg(*aggregates)
        rest = [c for c in out.columns if c not in ("__w", *self.keys)]
        return out.select(*self.keys, F.col("__w.start").alias("starttime"), F.col("__w.end").alias("endtime"), *rest)


def top_n(df: DataFrame, n: int, keys: list[str], *order: Column, rank: str = "rank_number") -> DataFrame:
    """The first n rows of each key with their rank; Spark cuts each partition to n rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def interval_join(left: DataFrame, right: DataFrame, on: Column, time: Column, start: Column, end: Column) -> DataFrame:
    """Equi-join whose rows also have time within [start, end]."""
    return left.join(right, on & time.between(start, end))
