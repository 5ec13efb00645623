import random

import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

from cladeframe.llm.token_counts import EDITS, VOCABULARY, Counter, Edited, apply_edits, build_tree, with_trees


@pytest.fixture(scope="module")
def counter():
    with open(VOCABULARY, "rb") as f:
        return Counter(f.read())


def test_random_edits_against_a_full_count(counter):
    rng = random.Random(1)
    encode = lambda t: len(counter.encoding.encode_ordinary(t))
    for d in documents():
        text = d[1] or ""
        e = Edited(text, *build_tree(text, counter), counter)
        assert e.n_tokens == encode(text)
        for _ in range(8):
            n = len(e.text)
            at = rng.randrange(n + 1)
            removed = min(n - at, rng.choice([0, 0, 1, 3, 50, 3000]))
            e.edit(at, removed, rng.choice(["", " ", "\n\n  ", "'s", "word", " 12 é💥", "'", "   x", "many words " * rng.choice([1, 400])]))
            assert e.n_tokens == encode(e.text)
            assert e.starts == sorted(e.starts) and sum(e.sums[len(e.sums) // 2 :]) == e.n_tokens


def test_small_edits_encode_little(counter):
    text = " ".join(f"word{i}" for i in range(20000))
    e = Edited(text, *build_tree(text, counter), counter)
    e.edit(len(text) // 2, 4, "xyz")
    assert e.encoded < 200 and e.n_tokens == len(counter.encoding.encode_ordinary(e.text))


def test_operators(spark, counter):
    docs = documents()
    edits = F.when(F.col("doc_id") % 2 == 0, F.expr("array(struct(2 as at, 3 as removed, 'new ' as inserted), struct(0 as at, 9 as removed, '' as inserted), struct(999999 as at, 5 as removed, ' end' as inserted))").cast(EDITS))
    df = with_trees(frame(spark, docs).withColumn("n", F.lit(1)).withColumn("tree", F.lit(3)).withColumn("n_encoded", F.lit("x"))).withColumn("edits", edits)
    before = {str(r.text): r.tree.sums[1] for r in df.collect()}
    for t, n in before.items():
        assert n == len(counter.encoding.encode_ordinary("" if t == "None" else t))
    rows = apply_edits(df).collect()
    assert len(rows) == len(docs)
    source = {(d[0], i): d[1] for i, d in enumerate(docs)}
    for r in rows:
        assert r.tree.sums[1] == len(counter.encoding.encode_ordinary(r.text or ""))
        if r.doc_id is not None and r.doc_id % 2 == 0:
            options = [t or "" for (i, _), t in source.items() if i == r.doc_id]
            assert r.text in {(t[:0] + t[2:] if len(t) >= 2 else "")[:0] + "new " + t[5:] + " end" for t in options}
        else:
            assert r.n_encoded == 0
    assert apply_edits(with_trees(frame(spark, [])).withColumn("edits", F.lit(None).cast(EDITS))).count() == 0
