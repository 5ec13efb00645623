from fixtures import frame, words
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm.decontamination import contamination
from cladeframe.llm.quality import quality
from cladeframe.llm.secret_scan import RULES, pattern_matches

D = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    read = lambda n: spark.read.parquet(f"{D}/{n}.parquet")
    docs = first = read("documents")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
        if i < 4:
            assert docs.columns == first.columns, name
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in [first, *out]]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    kept = {r.doc_id for r in quality(first, read("labels")).where("kept").collect()}
    assert ids[1] == kept
    hits = {r.doc_id for r in contamination(out[1], read("benchmark")).collect()}
    assert hits and ids[3] == ids[2] - hits
    before = {r.doc_id: r.text for r in out[2].collect()}
    after = {r.doc_id: r.text for r in out[3].collect()}
    found = {i for i, t in before.items() if any(pattern_matches(r, t) for r in RULES)}
    assert {i for i in before if before[i] != after[i]} == found
    assert not any(pattern_matches(r, t) for t in after.values() for r in RULES[1:])
    sizes = {r.doc_id: r["size"] for r in out[4].collect()}
    assert sizes == {i: len(words(t)) for i, t in after.items()}
    run = corpus_pipeline.run(spark, D)
    assert sorted(map(str, run.collect())) == sorted(map(str, out[4].collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Each stage on rows with nulls in every column, repeats, a very long text and clashing names; and on no rows."""
    text = " ".join(f"word{i} and" for i in range(60)) + "."
    rows = [
        (1, text, "en", "s0", 1), (1, text, "en", "s0", 1), (2, text + " more", None, None, None), (None, text.replace("word7", "other"), "en", "s1", 1),
        (3, None, None, None, None), (3, None, None, None, None), (4, "", "de", "s1", 0), (5, " ".join(str(i) for i in range(200_000)), "en", "s0", 1),
        (6, " ".join(f"z{i}" for i in range(40)) + " password=abcdefgh", "en", None, 1),
    ]
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (None, None, None)], labels).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a benchmark item that none of the texts above holds in any part of it, for sure")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = frame(spark, some).withColumn("row", F.lit(1)).withColumn("node", F.lit("n")).withColumn("__spans", F.lit(2))
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns, name
            got = out.collect()
            if some:
                assert {"quality_rules": {None, 1, 2, 5, 6}, "simhash_near_dedup": {1, 5, 6}}.get(name, {1, 5, 6}) == {r.doc_id for r in got}, name
            else:
                assert got == []
            docs = spark.createDataFrame(got, out.schema)
    whole = [corpus_pipeline.STAGES[k][1](spark, frame(spark, rows), str(tmp_path)) for k in (2, 3, 4)]
    assert [x.count() for x in whole] == [len(rows)] * 3


def test_run_leaves_only_its_result(spark):
    import os

    from cladeframe.functions.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/cladeframe"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, D)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["pipeline-source_mixing"]
    assert out.count() > 0
