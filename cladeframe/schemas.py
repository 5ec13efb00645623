"""Schemas of the tables between steps, as DDL strings."""

SPECIES = "species_id int, file_name string, file_size bigint"
PROTEIN = "protein_id bigint, species_id int, name string, seq string"
CLUSTER = "rep_id bigint, member_id bigint"
HSP = "query bigint, target bigint, qstart int, qend int, sstart int, cigar string, ord int"
NO_TREE = "query bigint, member bigint"
ALIGNMENT = "query bigint, target bigint, row string"
TREE = "query bigint, newick string"
LADDER = "query bigint, leaf bigint, step int"
PAIR_COUNT = "a bigint, b bigint, n_ortho bigint, n_para bigint"
EDGE = "src bigint, dst bigint, weight double, qstart int, qend int"
COMMUNITY = "id bigint, og bigint"
OG = "og_name string, protein_id bigint"
