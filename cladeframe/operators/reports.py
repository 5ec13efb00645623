"""Orthologous groups and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.indexing import with_index


def name_groups(members: DataFrame, species: DataFrame) -> DataFrame:
    """(og_name, protein_id): communities of more than one species, named in order of their least member, then size."""
    per = members.join(species, "id").groupBy("og").agg(
        F.countDistinct("species").alias("n_species"), F.min("id").alias("least"), F.count("*").alias("size")
    )
    named = with_index(per.where("n_species > 1"), [F.col("least"), F.col("size"), F.col("og")], "number")
    return members.join(named.select("og", "number"), "og").select(F.concat(F.lit("OG_"), F.col("number").cast("string")).alias("og_name"), F.col("id").alias("protein_id"))


def expanded(og: DataFrame, cluster: DataFrame, protein: DataFrame) -> DataFrame:
    """(og_name, rep_id, protein_id, species_id, name): members with all sequences they represent."""
    p = protein.select("protein_id", "species_id", "name")
    return (
        og.withColumnRenamed("protein_id", "rep_id").join(cluster.select("rep_id", "member_id"), "rep_id").join(p, F.col("member_id") == p["protein_id"])
        .select("og_name", "rep_id", "protein_id", "species_id", "name")
    )


def groups_list(full: DataFrame) -> DataFrame:
    """(og_name, protein_names): names joined by spaces, in order."""
    return full.groupBy("og_name").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("protein_names"))


def group_statistics(og: DataFrame, full: DataFrame, edges: DataFrame, species: DataFrame) -> DataFrame:
    """(og_name, nb_species, nb_reduced_prot, nb_all_prot, clustering_coefficient)."""
    base = og.join(species, og["protein_id"] == species["id"]).groupBy("og_name").agg(
        F.countDistinct("species").alias("nb_species"), F.count("*").alias("nb_reduced_prot")
    )
    every = full.groupBy("og_name").agg(F.count("*").alias("nb_all_prot"))
    a = og.select("og_name", F.col("protein_id").alias("src"))
    b = og.select("og_name", F.col("protein_id").alias("dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, ["og_name", "dst"]).groupBy("og_name").agg(F.count("*").alias("inner"))
    n = F.col("nb_reduced_prot")
    return base.join(every, "og_name").join(inner, "og_name", "left").select(
        "og_name",
        "nb_species",
        "nb_reduced_prot",
        "nb_all_prot",
        F.bround(F.coalesce(F.try_divide(F.coalesce("inner", F.lit(0)).cast("double"), n * (n - 1)), F.lit(0.0)), 4).alias("clustering_coefficient"),
    )


def species_columns(species: DataFrame) -> list[str]:
    """File names of the species in order: the columns of the tables of groups."""
    return [r[0] for r in species.orderBy("species_id").select("file_name").collect()]


def group_table(full: DataFrame, species: DataFrame, names: bool = False) -> DataFrame:
    """Groups by species: counts of proteins, or their names joined by spaces."""
    columns = species_columns(species)
    rows = full.join(species.select("species_id", "file_name"), "species_id").groupBy("og_name").pivot("file_name", columns)
    if names:
        return rows.agg(F.array_join(F.array_sort(F.collect_list("name")), " ")).na.fill("")
    return rows.agg(F.count("name")).na.fill(0)


def chimera_report(fused: DataFrame, og: DataFrame, protein: DataFrame, species: DataFrame) -> DataFrame:
    """(species_file, protein_name, nb_OG_fused, list_fused_OGs), also for those left in no group."""
    ids = fused.select("id").distinct()
    lists = og.groupBy(F.col("protein_id").alias("id")).agg(F.array_sort(F.collect_list("og_name")).alias("ogs"))
    return (
        ids.join(lists, "id", "left").join(protein.withColumnRenamed("protein_id", "id"), "id").join(species.select("species_id", "file_name"), "species_id")
        .select(
            F.col("file_name").alias("species_file"),
            F.col("name").alias("protein_name"),
            F.coalesce(F.size("ogs"), F.lit(0)).alias("nb_OG_fused"),
            F.coalesce(F.array_join("ogs", " "), F.lit("")).alias("list_fused_OGs"),
        )
    )


def unclassified(full: DataFrame, protein: DataFrame) -> DataFrame:
    """(protein_name): names in no group."""
    return protein.select("name").distinct().join(full.select("name"), "name", "left_anti").select(F.col("name").alias("protein_name"))


def species_statistics(full: DataFrame, reduced: DataFrame, species: DataFrame) -> DataFrame:
    """(species, perc_prot_assigned, nb_prot_assigned).

    Assigned members are counted once a group and with all sequences they
    represent, over the reduced proteins, so the share can pass 100.
    """
    got = full.groupBy("species_id").agg(F.count("*").alias("n"))
    total = reduced.groupBy("species_id").agg(F.count("*").alias("total"))
    return species.join(total, "species_id").join(got, "species_id", "left").select(
        F.col("file_name").alias("species"),
        F.bround(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 1).alias("perc_prot_assigned"),
        F.coalesce("n", F.lit(0)).alias("nb_prot_assigned"),
    )


def groups_by_species_count(statistics: DataFrame, n_species: int) -> DataFrame:
    """(nb_species, nb_OGs) for 0 to the number of species."""
    spine = statistics.sparkSession.range(n_species + 1).select(F.col("id").alias("nb_species"))
    got = statistics.groupBy("nb_species").agg(F.count("*").alias("nb_OGs"))
    return spine.join(got, "nb_species", "left").select("nb_species", F.coalesce("nb_OGs", F.lit(0)).alias("nb_OGs"))


def cluster_log(cluster: DataFrame, species: DataFrame) -> DataFrame:
    """(index, file_name, nb_initial, nb_final) of the reduction by k-mers."""
    per = cluster.groupBy("grp").agg(F.count("*").alias("nb_initial"), F.countDistinct("rep_id").alias("nb_final"))
    return species.join(per, species["species_id"] == per["grp"], "left").select(
        F.col("species_id").alias("index"), "file_name", F.coalesce("nb_initial", F.lit(0)).alias("nb_initial"), F.coalesce("nb_final", F.lit(0)).alias("nb_final")
    )


def phylome_log(census: DataFrame, aligned: DataFrame, trees: DataFrame, reduced: DataFrame, species: DataFrame) -> DataFrame:
    """(species_file, nb_phylo, nb_NO_phylo, nb_empty_ali, nb_pbm_tree)."""
    q = census.select("query", "has_tree").join(aligned.select("query").distinct().withColumn("ali", F.lit(True)), "query", "left")
    q = q.join(trees.select("query").distinct().withColumn("tree", F.lit(True)), "query", "left")
    q = q.join(reduced.select(F.col("protein_id").alias("query"), "species_id"), "query")
    per = q.groupBy("species_id").agg(
        F.count_if("has_tree").alias("nb_phylo"),
        F.count_if(~F.col("has_tree")).alias("nb_NO_phylo"),
        F.count_if(F.col("has_tree") & F.col("ali").isNull()).alias("nb_empty_ali"),
        F.count_if(F.col("has_tree") & F.col("ali").isNotNull() & F.col("tree").isNull()).alias("nb_pbm_tree"),
    )
    return species.join(per, "species_id").select(F.col("file_name").alias("species_file"), "nb_phylo", "nb_NO_phylo", "nb_empty_ali", "nb_pbm_tree")
