"""Running sums and maxima over array columns, in DataFrame operations only.

An array that grows by an element a step is copied at each step.  Here a block
of ``BLOCK`` elements is scanned alone and blocks are put together by their
totals, so an array of n elements costs about n * (BLOCK + n / BLOCK**2) copies
instead of n * n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element the sum (or maximum) of those before it, 0 for the first.

    ``values`` is an array<long> column, best a plain one: it is read once a block.
    """
    none = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")

    def inner(acc: Column, x: Column) -> Column:
        return F.struct(plus(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    def block(i: Column) -> Column:
        return F.aggregate(F.slice(values, i * BLOCK + 1, BLOCK), F.struct(zero.alias("now"), none.alias("out")), inner)

    def outer(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda v: plus(acc["now"], v))
        return F.struct(plus(acc["now"], b["now"]).alias("now"), F.concat(acc["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), block)
    start = F.struct(zero.alias("now"), F.array().cast("array<array<long>>").alias("out"))
    return F.when(F.size(values) > 0, F.flatten(F.aggregate(blocks, start, outer, lambda acc: acc["out"]))).otherwise(none)


def sums_before(values: Column) -> Column:
    return before(values, lambda a, b: a + b)


def most_before(values: Column) -> Column:
    return before(values, F.greatest)
