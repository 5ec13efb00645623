"""The four steps of an orthology run, each from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe import schemas
from cladeframe.config import OrthologyConfig
from cladeframe.functions.storage import materialize
from cladeframe.operators import align, census, chimera, communities, events, kmers, network, reports, search, trees
from cladeframe.sources import fasta, tables


def step1(spark: SparkSession, c: OrthologyConfig) -> None:
    """Read proteomes and collapse near-duplicates within each."""
    species, protein = fasta.read_proteomes(spark, c.dir, c.ext)
    species = tables.save(species, c.out, 1, "species")
    protein = tables.save(protein, c.out, 1, "protein")
    cluster = tables.save(kmers.kmer_clusters(protein, c.kmer_size, c.kmer_min_aa), c.out, 1, "cluster")
    reduced = protein.join(cluster.select(F.col("rep_id").alias("protein_id")).distinct(), "protein_id", "left_semi")
    reduced = tables.save(reduced, c.out, 1, "reduced_protein")
    fasta.write_fasta(reduced, f"{c.out}/dir_step1/fasta")
    tables.save_text(reports.cluster_log(cluster, species), c.out, 1, "log_step1.txt")
    named = protein.join(species, "species_id")
    tables.save_text(fasta.duplicate_names(named, order=("species_id", "protein_id")), c.out, 1, "duplicate_names.txt")


def step2(spark: SparkSession, c: OrthologyConfig) -> None:
    """Search, census, alignments and trees."""
    protein = tables.load(spark, c.out, 1, "reduced_protein", schemas.PROTEIN)
    species = tables.load(spark, c.out, 1, "species", schemas.SPECIES)
    hsp = tables.read_hits(spark, c.hits) if c.hits else search.search(protein, c.e_value, c.nb_hits)
    hsp = tables.save(hsp, c.out, 2, "hsp")
    told = tables.save(census.hit_census(hsp, _species_of(protein)), c.out, 2, "census")
    with_tree, no_tree = census.route(hsp, told)
    tables.save(no_tree, c.out, 2, "no_tree")
    aligned = tables.save(align.alignments(with_tree, protein, c.max_gap), c.out, 2, "alignment")
    made = tables.read_trees(spark, c.trees) if c.trees else trees.build_trees(aligned)
    made = tables.save(made, c.out, 2, "tree")
    tables.save(trees.ladders(made, root=bool(c.trees)), c.out, 2, "ladder")
    tables.save_text(reports.phylome_log(told, aligned, made, protein, species), c.out, 2, "log_step2.txt")


def _species_of(protein: DataFrame) -> DataFrame:
    return protein.select(F.col("protein_id").alias("id"), F.col("species_id").alias("species"))


def with_species(ladder: DataFrame, protein: DataFrame) -> DataFrame:
    return ladder.join(_species_of(protein).withColumnRenamed("id", "leaf"), "leaf")


def infer_groups(ladder: DataFrame, no_tree: DataFrame, hsp: DataFrame, species_of: DataFrame, n_species: int, c: OrthologyConfig) -> dict[str, DataFrame]:
    """Network, communities, fused sequences and named groups from ladders (with species) and hits."""
    counts = materialize(events.pair_counts(events.label_leaves(ladder, c.sp_overlap), no_tree), "pairs")
    all_edges = materialize(network.network_edges(counts), "network")
    weighted = materialize(network.edge_weights(all_edges), "weights")
    spans = materialize(network.hit_spans(hsp), "spans")
    edges = materialize(network.attach_hits(network.strong_edges(weighted, c.min_weight), spans), "edges")
    ids = network.network_nodes(all_edges)
    others = materialize(network.other_hits(edges, spans).join(ids.withColumnRenamed("id", "query"), "query", "left_semi"), "others")
    lcc = materialize(network.clustering(ids, edges, n_species), "lcc")
    members = materialize(communities.components_of(ids, edges), "components")
    found = materialize(communities.communities(lcc.join(species_of, "id"), edges, members), "communities")
    fused = materialize(chimera.chimeras(found, edges, species_of, c.chimeric_nb_sp, c.chimeric_shared), "fused")
    kept = materialize(chimera.supported(chimera.with_chimeras(found, fused), edges, others, c.min_nb_hits), "kept")
    og = materialize(reports.name_groups(kept, species_of), "og")
    return {"pair_count": counts, "network": all_edges, "weights": weighted, "edge": edges, "other_hits": others, "node": lcc, "component": members, "community": found, "fused": fused, "og": og}


def step3(spark: SparkSession, c: OrthologyConfig) -> None:
    """Orthologous groups and the reports on them."""
    protein = tables.load(spark, c.out, 1, "protein", schemas.PROTEIN)
    reduced = tables.load(spark, c.out, 1, "reduced_protein", schemas.PROTEIN)
    species = tables.load(spark, c.out, 1, "species", schemas.SPECIES)
    cluster = tables.load(spark, c.out, 1, "cluster", schemas.CLUSTER)
    hsp = tables.load(spark, c.out, 2, "hsp")
    no_tree = tables.load(spark, c.out, 2, "no_tree", schemas.NO_TREE)
    ladder = with_species(tables.load(spark, c.out, 2, "ladder", schemas.LADDER), reduced)
    n_species = species.count()
    of = _species_of(reduced)
    made = infer_groups(ladder, no_tree, hsp, of, n_species, c)
    for name in ("pair_count", "edge", "node", "component", "community", "og"):
        tables.save(made[name], c.out, 3, name)
    full = materialize(reports.expanded(made["og"], cluster, protein), "full")
    stats = materialize(reports.group_statistics(made["og"], full, made["edge"], of), "stats")
    for name, report in (
        ("orthologous_groups.txt", reports.groups_list(full)),
        ("chimeric_proteins.txt", reports.chimera_report(made["fused"], made["og"], protein, species)),
        ("unclassified_proteins.txt", reports.unclassified(full, protein)),
        ("statistics_per_OG.txt", stats),
        ("table_OGs_protein_counts.txt", reports.group_table(full, species)),
        ("table_OGs_protein_names.txt", reports.group_table(full, species, names=True)),
        ("statistics_per_species.txt", reports.species_statistics(full, reduced, species)),
        ("statistics_nb_OGs_VS_nb_species.txt", reports.groups_by_species_count(stats, n_species)),
        ("log_network_size.txt", network.network_size(made["network"])),
        ("log_edge_weights.txt", network.weight_histogram(made["weights"])),
    ):
        tables.save_text(report, c.out, 3, name, header=name != "unclassified_proteins.txt")
    n = lambda df: df.count()
    summary = [
        ("edges_removed", (n(made["network"]) - n(made["edge"])) // 2),
        ("connected_components", made["component"].select("component").distinct().count()),
        ("communities", made["community"].select("og").distinct().count()),
        ("chimeric_proteins", made["fused"].select("id").distinct().count()),
    ]
    tables.save_text(spark.createDataFrame(summary, "name string, n long"), c.out, 3, "log_step3.txt")


def step4(spark: SparkSession, c: OrthologyConfig) -> None:
    """Orthologous pairs within groups."""
    protein = tables.load(spark, c.out, 1, "protein", schemas.PROTEIN)
    reduced = tables.load(spark, c.out, 1, "reduced_protein", schemas.PROTEIN)
    cluster = tables.load(spark, c.out, 1, "cluster", schemas.CLUSTER)
    no_tree = tables.load(spark, c.out, 2, "no_tree", schemas.NO_TREE)
    ladder = with_species(tables.load(spark, c.out, 2, "ladder", schemas.LADDER), reduced)
    og = tables.load(spark, c.out, 3, "og", schemas.OG)
    counts = events.group_pair_counts(ladder, no_tree, og)
    pairs = events.expand_pairs(events.ortholog_pairs(counts, c.ratio_ortho), cluster, protein, c.not_same_sp)
    tables.save_text(pairs, c.out, 4, "orthologous_pairs.txt", header=False)


def run(spark: SparkSession, c: OrthologyConfig) -> None:
    """The steps that the configuration names, in order."""
    for s in c.validate().step_list():
        (step1, step2, step3, step4)[s - 1](spark, c)
