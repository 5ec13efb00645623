"""Chimeric (fused) sequences and spurious members of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.medians import exact_medians
from cladeframe.functions.storage import materialize


def chimeras(found: DataFrame, edges: DataFrame, species: DataFrame, min_species: int = 3, min_share: float = 0.5) -> DataFrame:
    """(id, og): further communities that a fused sequence belongs to.

    ``found`` is (id, component, og, split) with one community an id, ``edges`` has
    the hulls of direct hits, ``species`` is (id, species).  A sequence's
    neighbours by direct hits must link it to its own community and to others,
    each by enough species and a large enough part of the community; it is fused
    with those whose median hit interval does not overlap that of its own.
    """
    part = found.where("split")
    size = part.groupBy("og").agg(F.count("*").alias("size"))
    own = part.select(F.col("id").alias("src"), F.col("og").alias("own"), F.col("component").alias("c1"))
    near = part.select(F.col("id").alias("dst"), "og", F.col("component").alias("c2"))
    links = edges.where(F.col("qend").isNotNull()).join(own, "src").join(near, "dst").where("c1 = c2").join(species.toDF("dst", "species"), "dst")
    links = materialize(links.select("src", "own", "og", "species", "qstart", "qend"), "community-links")
    # Most communities of a sequence are too little linked, which counts tell; they are written, so that their size is known and links stay where they are.
    keys = ["src", "own", "og"]
    large = links.groupBy(*keys).agg(F.count("*").alias("n")).join(size, "og").where(F.col("n") >= F.col("size") * F.lit(float(min_share))).select(*keys)
    large = links.join(materialize(large, "communities-linked"), keys, "left_semi")
    able = materialize(large.groupBy(*keys).agg(F.countDistinct("species").alias("n_species")).where(F.col("n_species") >= min_species).select(*keys), "communities-able")
    able = exact_medians(links.join(able, keys, "left_semi"), keys, ["qstart", "qend"])
    able = materialize(able.withColumnsRenamed({"qstart": "start", "qend": "end"}), "community-intervals")
    ref = able.where("own = og").select("src", F.col("start").alias("rs"), F.col("end").alias("re"))
    gap = F.when(F.col("start") > F.col("rs"), F.col("re") - F.col("start")).otherwise(F.col("end") - F.col("rs"))
    return able.where("own <> og").join(ref, "src").where(gap <= 0).select(F.col("src").alias("id"), "og")


def with_chimeras(found: DataFrame, fused: DataFrame) -> DataFrame:
    """(id, og) of all memberships."""
    return found.select("id", "og").unionByName(fused)


def supported(members: DataFrame, edges: DataFrame, others: DataFrame, min_hits: int = 2) -> DataFrame:
    """Memberships with enough hits within their community, counted before any removal, in one pass.

    Communities of up to ``min_hits`` + 1 members stay as they are.
    """
    size = members.groupBy("og").agg(F.count("*").alias("size"))
    direct = edges.where(F.col("qend").isNotNull()).select(F.col("src").alias("id"), F.col("dst").alias("k"))
    hits = direct.unionByName(others.select(F.col("query").alias("id"), F.col("target").alias("k")))
    # Hits between communities go before repeated ones do, so that few are sent.
    within = hits.join(members.distinct(), "id").join(members.select(F.col("id").alias("k"), "og").distinct(), ["k", "og"])
    inside = within.select("id", "og", "k").distinct().groupBy("id", "og").agg(F.count("*").alias("hits"))
    return (
        members.join(size, "og").join(inside, ["id", "og"], "left").where((F.col("size") <= min_hits + 1) | (F.coalesce("hits", F.lit(0)) >= min_hits)).select("id", "og")
    )
