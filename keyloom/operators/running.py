"""Running sums and previous values per key that do not need a key in one task.

A key's rows are cut into blocks of sequence numbers. Sums run within (key, block); blocks' totals, a row
each, run once more per key and are added back. So a hot key spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of a block.
BLOCK = 1 << 20
ORDER = ("sequence", "branch")


def wrapped(value: Column) -> Column:
    """A decimal wrapped to a signed 64-bit number."""
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    return (F.pmod(value.cast("decimal(38,0)") + half, whole) - half).cast("bigint")


def running(df: DataFrame, sums: dict[str, str], previous: dict[str, str] | None = None, block: int = BLOCK, wrap: bool = False) -> DataFrame:
    """df with, per key in order of (sequence, branch): sums[name], the running total of an expression, and
    previous[name], the expression's value in the row before (null in a key's first row).

    wrap: sums of long expressions wrap around at 64 bits instead of failing; they are exact decimals until then.
    """
    previous = previous or {}
    rows = df.withColumn("__block", F.expr(f"sequence div {block}"))
    for n, e in {**sums, **previous}.items():
        rows = rows.withColumn(f"__{n}", F.expr(e).cast("decimal(20,0)") if wrap and n in sums else F.expr(e))
    inner = Window.partitionBy("key", "__block").orderBy(*ORDER)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*ORDER)
    totals = rows.groupBy("key", "__block").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums], *[F.max_by(f"__{n}", position).alias(f"__t_{n}") for n in previous], F.count("*").alias("__rows"))
    outer = Window.partitionBy("key").orderBy("__block")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("key").alias("__key"), F.col("__block").alias("__b"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums], *[F.lag(f"__t_{n}").over(outer).alias(f"__s_{n}") for n in previous]
    )
    done = rows.select(
        *df.columns,
        "__block",
        *[F.sum(f"__{n}").over(upto).alias(f"__r_{n}") for n in sums],
        *[F.lag(f"__{n}").over(inner).alias(f"__r_{n}") for n in previous],
        F.row_number().over(inner).alias("__place"),
    )
    total = lambda n: F.col(f"__r_{n}") + F.col(f"__s_{n}")
    final = (lambda n: wrapped(total(n))) if wrap else total
    joined = done.join(starts, done.key.eqNullSafe(F.col("__key")) & done["__block"].eqNullSafe(F.col("__b")))
    return joined.select(
        *df.columns, *[final(n).alias(n) for n in sums], *[F.when(F.col("__place") == 1, F.col(f"__s_{n}")).otherwise(F.col(f"__r_{n}")).alias(n) for n in previous]
    )


def running_in_key(df: DataFrame, sums: dict[str, str], previous: dict[str, str] | None = None, wrap: bool = False) -> DataFrame:
    """As running, by one window over each key: for keys of no more than a block's rows. Operators that keep the key share
    its partitioning and order."""
    previous = previous or {}
    order = Window.partitionBy("key").orderBy(*ORDER)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda e: wrapped(F.sum(F.expr(e).cast("decimal(20,0)")).over(upto)) if wrap else F.sum(F.expr(e)).over(upto)
    return df.select(*df.columns, *[total(e).alias(n) for n, e in sums.items()], *[F.lag(F.expr(e)).over(order).alias(n) for n, e in previous.items()])


def rows_of_largest_key(df: DataFrame) -> int:
    return df.groupBy("key").count().agg(F.max("count")).first()[0] or 0
