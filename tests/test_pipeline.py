import glob

import proteomes
import pytest

from cladeframe.config import OrthologyConfig
from cladeframe.plans import pipeline
from cladeframe.sources import tables


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    files, families = proteomes.make()
    (d / "in").mkdir()
    for name, text in files.items():
        (d / "in" / name).write_text(text)
    pipeline.run(spark, OrthologyConfig(dir=str(d / "in"), out=str(d)))
    return str(d), families


def lines(base, name):
    return [x.rstrip("\n").split("\t") for f in sorted(glob.glob(f"{base}/{name}/part*")) for x in open(f)]


def test_near_duplicate_is_collapsed(result, spark):
    base, _ = result
    names = {r.protein_id: r.name for r in tables.load(spark, base, 1, "protein").collect()}
    got = [(names[r.rep_id], names[r.member_id]) for r in tables.load(spark, base, 1, "cluster").collect() if r.rep_id != r.member_id]
    assert ("s0f1", "s0f1dup") in got
    assert all(a.split("f")[1][:1] == b.split("f")[1][:1] for a, b in got)


def test_groups_hold_whole_families(result):
    base, families = result
    groups = [x[1].split() for x in lines(base, "dir_step3/orthologous_groups.txt") if x[0] != "og_name"]
    for f in (0, 1, 4, 5):
        own = {n for n, fam in families.items() if f in fam}
        assert sum(own <= set(g) for g in groups) == 1
        assert any(own == set(g) for g in groups)


def test_pairs_join_members_of_a_family(result):
    base, families = result
    pairs = lines(base, "dir_step4/orthologous_pairs.txt")
    assert len(pairs) > 50
    assert all(families[a] & families[b] for a, b in pairs)
    assert any("s0f1dup" in p for p in pairs)


def test_every_report_is_there(result):
    base, _ = result
    for step, names in {
        1: ["log_step1.txt", "duplicate_names.txt", "fasta"],
        2: ["log_step2.txt"],
        3: [
            "orthologous_groups.txt", "chimeric_proteins.txt", "unclassified_proteins.txt", "statistics_per_OG.txt", "table_OGs_protein_counts.txt",
            "table_OGs_protein_names.txt", "statistics_per_species.txt", "statistics_nb_OGs_VS_nb_species.txt", "log_step3.txt", "log_edge_weights.txt", "log_network_size.txt",
        ],
        4: ["orthologous_pairs.txt"],
    }.items():
        for n in names:
            assert glob.glob(f"{base}/dir_step{step}/{n}/**/part*", recursive=True), n


def test_ingested_hits_give_the_same_groups(result, spark, tmp_path):
    base, _ = result
    hits = tables.load(spark, base, 2, "hsp").drop("ord")
    hits.write.csv(str(tmp_path / "hits"), sep="\t", compression="gzip")
    for name in ("protein", "reduced_protein", "species", "cluster"):
        tables.load(spark, base, 1, name).write.parquet(str(tmp_path / "dir_step1" / name))
    pipeline.run(spark, OrthologyConfig(steps="2,3", out=str(tmp_path), hits=str(tmp_path / "hits")))
    same = lambda b: sorted(tuple(x) for x in lines(b, "dir_step3/orthologous_groups.txt"))
    assert same(base) == same(str(tmp_path))
