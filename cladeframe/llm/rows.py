"""Naming rows by two hashes, and keeping one row of each name but those that go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize

#: Together 128 bits, so that no two different rows of any corpus meet.
NAMES = ("row", "row2")


def row_names(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of a row's id and text; equal rows have equal ones."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(i, t).alias(NAMES[0]), F.xxhash64(t, F.lit("second"), i).alias(NAMES[1])]


def keep_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` (row, row2) names, one of each name, with all their columns.

    Texts are shuffled once, by name, at every size: neither table is bounded.
    Of repeated rows each task sends one on; of those that differ in other
    columns the one with the least hash of all columns stays, so reruns agree.
    """
    own = []
    for n in (*NAMES, "turn"):
        n = "__" + n
        while n in docs.columns:
            n += "_"
        own.append(n)
    *names, turn = own
    named = docs.withColumns(dict(zip(names, row_names(id_col, text_col))))
    order = Window.partitionBy(*names).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    one = named.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    gone = materialize(gone.select(*NAMES), "gone-rows").withColumnsRenamed(dict(zip(NAMES, names)))
    return one.join(gone.hint("merge"), names, "left_anti").drop(*own)
