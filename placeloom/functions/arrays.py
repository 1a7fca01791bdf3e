"""Running values over arrays in about linear work, inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions.extract import bound

BLOCK = 512


def blocks(values: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size``; of an empty one there are none."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, F.lit(size)))
    return bound(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.slice(F.array(v), 2, 1)))


def running(values: Column, zero: Column, plus: Callable[[Column, Column], Column], size: int = BLOCK) -> Column:
    """For each value what ``plus`` makes of all values before it, from ``zero`` on.

    A fold that appends to its result copies it at every step. Here folds run over blocks of ``size`` and over the blocks' totals, so n values
    cost n * size / 2 copied numbers, and the blocks' totals a small square."""

    def fold(start: Column, items: Column) -> Column:
        seed = F.struct(start.alias("at"), F.slice(F.array(start), 2, 1).alias("out"))
        return F.aggregate(items, seed, lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    totals = lambda cut: F.transform(cut, lambda b: F.aggregate(b, zero, plus))
    return bound(blocks(values, size), lambda cut: F.flatten(F.zip_with(fold(zero, totals(cut)), cut, fold)))


def running_sums(values: Column, size: int = BLOCK) -> Column:
    """Of longs: the sum of all values before each."""
    return running(values, F.lit(0).cast("long"), lambda a, x: a + x, size)
