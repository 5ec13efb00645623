"""Connected components of an edge table, in alternating star contractions.

Large-star links each larger neighbour of a node to the smallest node in its
neighbourhood; small-star links the smaller neighbours of a node to the least
of them.  Both keep the components and the number of rounds is logarithmic.
Only minima are aggregated, so a hub of any degree is pre-aggregated on the
map side and never gathered in one task.  Each round is written to the shared
folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = (
        large.join(low, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(low.select("a", F.col("m").alias("b")))
    )
    return small.distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is its least node.

    Rows with a null end and self loops give no link; repeated and reversed
    edges count once; an empty table gives an empty result.  Raises if the
    contraction has not settled after ``max_rounds``.
    """
    s, d = F.col(src), F.col(dst)
    now = materialize(
        edges.where(s.isNotNull() & d.isNotNull() & (s != d))
        .select(F.greatest(s, d).alias("a"), F.least(s, d).alias("b"))
        .distinct(),
        "cc",
    )
    seen = _signature(now)
    if seen[0]:
        for _ in range(max_rounds):
            new = materialize(_round(now), "cc")
            discard(now)
            now, got = new, _signature(new)
            if got == seen:
                break
            seen = got
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
