"""Consecutive numbers in a global order without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize


def with_index(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with a consecutive number in the given order.

    Rows are range-partitioned, numbered within partitions, and shifted by the
    counts of earlier partitions, a table of one row a partition.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "index")
    counts = dealt.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        dealt.withColumn("__own", own)
        .join(shift, "__part")
        .withColumn(name, F.col("__own") + F.col("__shift") + (start - 1))
        .drop("__part", "__own", "__shift")
    )
