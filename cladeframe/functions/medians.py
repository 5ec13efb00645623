"""Exact medians of groups of any size, by counts of values and ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize


def exact_medians(rows: DataFrame, keys: list[str], values: list[str], width: int = 1024) -> DataFrame:
    """(keys, values): for each key the median of each value column, nulls left out, null if there is none.

    Equal values are counted where they are read.  Of a key's ranges of ``width``
    those that hold the two middle ranks are found by running counts over ranges,
    and only their values are ranked, so no key's values are gathered: a key of any
    number of rows costs a row a range in one task, and what the ranges chosen hold.
    """
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values))))
    told = rows.select(*keys, names.alias("x")).select(*keys, "x.i", "x.v").where("v IS NOT NULL")
    counts = materialize(told.groupBy(*keys, "i", "v").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("v") / width)), "values")
    own = [*keys, "i"]
    spans = counts.groupBy(*own, "span").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*own).orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("upto", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy(*own)))
    # ranks from 1: of an odd number both are the middle one
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
    chosen = spans.where(holds(low) | holds(high)).select(*own, "span", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high"))
    within = Window.partitionBy(*own, "span").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(chosen, [*own, "span"]).withColumn("upto", F.sum("n").over(within) + F.col("before"))
    ends = ranked.groupBy(*own).agg(F.max(F.when(holds(F.col("low")), F.col("v"))).alias("a"), F.max(F.when(holds(F.col("high")), F.col("v"))).alias("b"))
    mid = (F.col("a") + F.col("b")) / 2
    return ends.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, mid)).alias(v) for i, v in enumerate(values)))
