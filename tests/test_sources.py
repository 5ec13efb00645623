import gzip

import pytest
from pyspark.sql import functions as F

from cladeframe.config import OrthologyConfig, parse_args
from cladeframe.sources import fasta, tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fa")
    (d / "a.fasta").write_text("preamble\n>A1 first > protein\nACDE  \nFGHI\n>A2\nKLMN\r\nPQ\n>A3 x y\n\n")
    (d / "b.fasta").write_text(">B1 one\n" + "ACDEFGHIKL\n" * 30 + ">A2 again\nWY*X\n")
    (d / "c.txt").write_text(">C1\nAC\n")
    return str(d)


def test_list_is_by_size_then_name(spark, folder):
    got = [tuple(r) for r in fasta.list_proteomes(spark, folder).orderBy("species_id").select("species_id", "file_name").collect()]
    assert got == [(0, "b.fasta"), (1, "a.fasta")]


def test_missing_folder_and_no_file_raise(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        fasta.list_proteomes(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        fasta.list_proteomes(spark, folder, ".fa")


def test_records(spark, folder):
    _, protein = fasta.read_proteomes(spark, folder)
    got = {(r.protein_id, r.species_id, r.name, r.seq) for r in protein.collect()}
    assert got == {
        (0, 0, "B1", "ACDEFGHIKL" * 30),
        (1, 0, "A2", "WY*X"),
        (2, 1, "A1", "ACDEFGHI"),
        (3, 1, "A2", "KLMNPQ"),
        (4, 1, "A3", ""),
    }
    headers = {r.header for r in fasta.read_fasta(spark, folder).collect()}
    assert "A1 first  protein" in headers


def test_records_keep_their_order_across_splits(spark, tmp_path):
    (tmp_path / "big.fasta").write_text("".join(f">p{i} x\n{'ACDEF' * 20}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["name"]: r["pos"] for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"p{i}": i for i in range(500)}


def test_duplicate_names(spark, folder):
    species, protein = fasta.read_proteomes(spark, folder)
    got = fasta.duplicate_names(protein.join(species, "species_id"), order=("species_id", "protein_id")).collect()
    assert [tuple(r) for r in got] == [("A2", "b.fasta", "a.fasta")]


def test_write_fasta(spark, folder, tmp_path):
    _, protein = fasta.read_proteomes(spark, folder)
    fasta.write_fasta(protein, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out") + "/species_id=1").collect()
    assert ">2" in {r[0] for r in text} and "ACDEFGHI" in {r[0] for r in text}


def test_hits_plain_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "h.tsv.gz", "wt") as f:
        f.write("1\t2\t3\t9\t1\t7M\n1\t2\t20\t29\t30\t10M\n")
    (tmp_path / "i.tsv").write_text("1\t1\t1\t30\t1\t30M\n")
    got = sorted(tuple(r) for r in tables.read_hits(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, 30, 1, "30M", 1), (1, 2, 3, 9, 1, "7M", 1), (1, 2, 20, 29, 30, "10M", 2)]


def test_trees_skip_notes_and_count_problems(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Ignored character\nWARNING x\n1\t(1,2);\n2\tbroken\n")
    got = [tuple(r) for r in tables.read_trees(spark, str(tmp_path / "t.txt")).collect()]
    assert got == [(1, "(1,2);")]
    with pytest.raises(ValueError):
        tables.read_trees(spark, str(tmp_path / "t.txt"), max_problems=0)


def test_load_needs_a_complete_step(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path), 1, "protein")
    tables.save(spark.range(3), str(tmp_path), 1, "x")
    assert tables.load(spark, str(tmp_path), 1, "x").count() == 3
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path), 1, "x", "query bigint")
    tables.save(spark.range(2), str(tmp_path), 1, "x")
    assert tables.load(spark, str(tmp_path), 1, "x").count() == 2


def test_a_failed_write_leaves_the_earlier_table_whole(spark, tmp_path):
    tables.save(spark.range(3), str(tmp_path), 1, "x")
    before = tables.load(spark, str(tmp_path), 1, "x")
    broken = spark.range(1000).repartition(8).selectExpr("CASE WHEN id = 900 THEN raise_error('lost') ELSE id END AS id")
    with pytest.raises(Exception, match="lost"):
        tables.save(broken, str(tmp_path), 1, "x")
    assert before.count() == tables.load(spark, str(tmp_path), 1, "x").count() == 3


def test_readers_keep_their_version_and_old_ones_go(spark, tmp_path):
    tables.save(spark.range(3), str(tmp_path), 1, "x")
    pinned = tables.load(spark, str(tmp_path), 1, "x")
    tables.save(spark.range(5), str(tmp_path), 1, "x")
    assert pinned.count() == 3 and tables.load(spark, str(tmp_path), 1, "x").count() == 5
    tables.save(spark.range(7), str(tmp_path), 1, "x")
    assert tables.load(spark, str(tmp_path), 1, "x").count() == 7
    assert len([p for p in (tmp_path / "dir_step1" / "x").iterdir() if p.is_dir()]) == 2


def test_tables_of_other_programs_and_reports(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "dir_step2" / "y"))
    assert tables.load(spark, str(tmp_path), 2, "y").count() == 4
    for n in (2, 6):
        tables.save_text(spark.range(n), str(tmp_path), 2, "r.txt", header=False)
        assert spark.read.text(str(tmp_path / "dir_step2" / "r.txt")).count() == n
    assert [p.name for p in (tmp_path / "dir_step2").iterdir() if p.name.startswith(".r")] == []


def test_files_that_are_not_asked_for_are_not_opened(spark, folder):
    df = fasta.read_fasta(spark, folder, only=["a.fasta"])
    assert sorted(r["name"] for r in df.collect()) == ["A1", "A2", "A3"]
    scan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "a.fasta" in scan
    raw = spark.read.text(folder).where(F.col("_metadata.file_name").isin(["a.fasta"]))
    assert raw.rdd.getNumPartitions() == 1 < spark.read.text(folder).where("value <> ''").rdd.getNumPartitions()


def test_config():
    c = parse_args(["-dir", "x", "-kmer_size", "50", "-steps", "1,2", "-not_same_sp"])
    assert (c.dir, c.kmer_size, c.step_list(), c.not_same_sp) == ("x", 50, [1, 2], True)
    assert parse_args(["-dir", "x", "-threads", "4"]).threads == 4
    for name, instead in (("path_diamond", "-hits"), ("path_fasttree", "-trees")):
        with pytest.raises(ValueError, match=instead):
            parse_args(["-dir", "x", f"-{name}", "/bin/x"])
    assert OrthologyConfig().kmer_min_aa == 15 and OrthologyConfig().max_gap == 0.7
    for bad in ({"steps": "1,3"}, {"steps": "0,1"}, {"steps": "a"}, {}, {"dir": "x", "phylogenies": "ml"}):
        with pytest.raises(ValueError):
            OrthologyConfig(**bad).validate()
