"""Row numbers over whole tables and over large keys, without a window that sorts them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.cut import cut

_INDEX = (1 << 33) - 1  # monotonically_increasing_id keeps the partition above this


def numbered(spark: SparkSession, rows: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows in order, from ``start``: range partitions are sorted on their own, and each begins where the rows of
    those before it end. Only one count per partition meets the driver."""
    placed = cut(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, total = [], start
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.get(F.lit(before) if before else F.array(F.lit(start)), part.cast("int"))  # by position, not by search
    return placed.withColumn(name, (offset + F.col("__at").bitwiseAND(F.lit(_INDEX))).cast("long")).drop("__at")


def ranked_within(spark: SparkSession, rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank from 1 inside each key in order, however many rows a key has: run-wide numbers less the key's first."""
    every = numbered(spark, rows, [*map(F.col, keys), *order], "__n")
    first = every.groupBy(*keys).agg(F.min("__n").alias("__first"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        same = one if same is None else same & one
    first = first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first")
    return every.join(first, same).withColumn(name, F.col("__n") - F.col("__first") + 1).drop("__n", "__first", *[f"__k_{k}" for k in keys])
