"""The weighted network of pairs, clustering coefficients and search hits on its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize
from cladeframe.operators.neighbours import pairs_with_edge


def network_edges(counts: DataFrame) -> DataFrame:
    """(src, dst, n): two rows for each pair with more orthologous than paralogous events."""
    kept = counts.where(F.col("n_ortho") > F.col("n_para"))
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n_ortho").alias("n")).unionByName(
        kept.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("n_ortho").alias("n"))
    )


def edge_weights(edges: DataFrame) -> DataFrame:
    """``edges`` with weight (n by the source's largest n) and back (the same seen from the target).

    The largest n of a node is aggregated before any removal, on the map side
    first, so hubs do not gather in one task.
    """
    most = edges.groupBy("src").agg(F.max("n").alias("most"))
    ahead = edges.join(most, "src").withColumn("weight", F.col("n").cast("double") / F.col("most")).drop("most")
    return ahead.join(most.toDF("dst", "most"), "dst").withColumn("back", F.col("n").cast("double") / F.col("most")).drop("most").select(
        "src", "dst", "n", "weight", "back"
    )


def strong_edges(weighted: DataFrame, min_weight: float = 0.1) -> DataFrame:
    """(src, dst, weight): edges that are strong enough from both ends."""
    return weighted.where((F.col("weight") >= min_weight) & (F.col("back") >= min_weight)).select("src", "dst", "weight")


def weight_histogram(weighted: DataFrame, bins: int = 20) -> DataFrame:
    """(edge_weight, nb_edges): all directed weights before removal, rounded half to even, empty bins included."""
    spark = weighted.sparkSession
    found = weighted.groupBy(F.bround(bins * F.col("weight"), 0).cast("int").alias("bin")).agg(F.count("*").alias("nb_edges"))
    spine = spark.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(found, "bin", "left").select((F.col("bin") / F.lit(float(bins))).alias("edge_weight"), F.coalesce("nb_edges", F.lit(0)).alias("nb_edges"))


def lcc_limits(n_species: int) -> tuple[int, int]:
    """(most neighbours looked at, denominator for nodes with more)."""
    most = 2 * n_species
    return (10, 90) if most < 10 else (most, most * (most - 1))


def clustering(nodes: DataFrame | None, edges: DataFrame, n_species: int) -> DataFrame:
    """(id, degree, lcc): local clustering coefficient, 0 below degree 4; without ``nodes``, of those with an edge.

    Above the limit only the smallest neighbours count, with a fixed denominator:
    the limit is part of the definition, and bounds the pairs of a node.  Edges
    may be repeated; if they are dealt by src, they are not dealt again.
    """
    most, top = lcc_limits(n_species)
    w = Window.partitionBy("src").orderBy("dst")
    ranked = edges.select("src", "dst", F.dense_rank().over(w).alias("rank"), F.lag("dst").over(w).alias("before"))
    ranked = materialize(ranked.where("before IS NULL OR before <> dst").drop("before"), "ranked-edges")
    degree = ranked.groupBy(F.col("src").alias("id")).agg(F.max("rank").cast("long").alias("degree"))
    near = ranked.where(F.col("rank") <= most).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"), F.max("rank").alias("last"))
    counts = pairs_with_edge(near.where("last >= 4 AND id IS NOT NULL"), ranked.where("src < dst"), ranked.count() // 2)
    d = F.col("degree")
    nb = F.when(d > most, F.lit(top)).otherwise(d * (d - 1))
    of = degree if nodes is None else nodes.select("id").join(degree, "id", "left")
    return of.join(counts, "id", "left").select(
        "id",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.when(d >= 4, F.bround(2.0 * F.coalesce("found", F.lit(0)) / nb, 5)).otherwise(0.0).alias("lcc"),
    )


def hit_spans(hits: DataFrame) -> DataFrame:
    """(query, target, qstart, qend): hull of all segments of a hit, hits on itself left out."""
    return hits.where("query <> target").groupBy("query", "target").agg(F.min("qstart").alias("qstart"), F.max("qend").alias("qend"))


def attach_hits(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """``edges`` with the hull of the direct hit src to dst, null if there is none."""
    s = spans.select(F.col("query").alias("src"), F.col("target").alias("dst"), "qstart", "qend")
    return edges.join(s, ["src", "dst"], "left")


def other_hits(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """(query, target) of the hits that are on no edge."""
    return spans.select("query", "target").join(edges.select(F.col("src").alias("query"), F.col("dst").alias("target")), ["query", "target"], "left_anti")


def network_nodes(edges: DataFrame) -> DataFrame:
    """(id) of all nodes, those that lose their edges later included."""
    return edges.select(F.col("src").alias("id")).distinct()


def network_size(edges: DataFrame) -> DataFrame:
    """(nodes, edges) of a network of two rows an edge."""
    return edges.agg(F.countDistinct("src").alias("nodes"), F.count_if(F.col("src") < F.col("dst")).alias("edges"))


def dense_range(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))
