import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from fixtures import LOWER, documents, frame, words
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import near_dedup as nd
from cladeframe.llm.near_dedup import keep_one


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(texts):
    """Pairs at 0.8 or more, by brute force over all of them: the component of each text, and how many such pairs aren't equal."""
    sets, parent, near = [shingles(t) for t in texts], list(range(len(texts))), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                near += a != b
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], near


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_documents():
    rng = random.Random(5)
    docs = documents()
    base = [d for d in docs if d[0] is not None and len(words(d[1])) > 60]
    out = [(1000 + i, edited(base[i % len(base)][1], rng, rng.randrange(1, 6)), "en", "s0", 1) for i in range(60)]
    say = " ".join(f"q{rng.randrange(400)}" for _ in range(120))
    chain = [say]  # a path: each text is near to the one before it only
    for _ in range(8):
        chain.append(edited(chain[-1], rng, 2))
    star = [edited(say, rng, rng.randrange(1, 4)) for _ in range(40)]
    return docs + out + [(2000 + i, t, "en", "s0", 1) for i, t in enumerate(chain + star)]


def want(docs):
    part, near = classes([d[1] for d in docs])
    assert near > 50
    return sorted(min((d[0] is None, d[0] or 0) for d, q in zip(docs, part) if q == p) for p in set(part))


def test_stage_against_brute_force(spark):
    docs = near_documents()
    kept = corpus_pipeline.simhash_near_dedup(spark, frame(spark, docs), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want(docs)


def test_dense_lists_link_as_pairs_do(spark):
    docs = near_documents()
    for leaders in (0, 1, 50):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in keep_one(frame(spark, docs), leaders=leaders).collect()) == want(docs)


def test_common_passages_link_nothing(spark):
    """Texts put together from passages that hundreds share, of which few are near."""
    rng = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(12)]
    docs = [(i, " ".join(rng.sample(passages, rng.randrange(2, 6))), "en", "s", 1) for i in range(300)]
    part, _ = classes([d[1] for d in docs])
    assert sorted(r.doc_id for r in keep_one(frame(spark, docs)).collect()) == sorted({min(d[0] for d, q in zip(docs, part) if q == p) for p in set(part)})


def test_frequencies_are_exact_in_small_ranges(monkeypatch):
    monkeypatch.setattr(nd, "RANGE", 64)
    texts = [d[1] for d in near_documents()]
    dealt = [pa.table({"text": texts[i::6], "chunk": pa.array([i] * len(texts[i::6]), pa.int32())}) for i in range(6)]
    sent = pa.concat_tables([nd._count_chunk(5, 3)(t) for t in dealt])
    told = pa.concat_tables([nd._tell_bucket(sent.filter(pc.equal(sent["bucket"], b))) for b in range(3)])
    hashes, want_counts = nd.WordHashes(), [{}, {}]
    for i in range(6):
        sets = {nd.shingle_set((t or "").encode(), 5, hashes).tobytes() for t in texts[i::6]}
        for s in sets:
            for g in set((np.frombuffer(s, np.uint64) >> nd.DROPPED).tolist()):
                want_counts[0][g] = want_counts[0].get(g, 0) + 1
                want_counts[1].setdefault(i, set()).add(g)
    for i in range(6):
        got = {}
        for r in told.filter(pc.equal(told["chunk"], i)).to_pylist():
            got |= dict(zip(nd._unpack(pa.py_buffer(r["hashes"]), r["n"]).tolist(), r["rarities"]))
        want = {g: want_counts[0][g] for g in want_counts[1][i] if want_counts[0][g] > 1}
        assert got == {g: int(nd.rarity(np.array([c]))[0]) for g, c in want.items()}


def test_repeated_rows_and_clashing_columns(spark):
    """Of rows with equal id and text one stays, the same in every run; a name of two hashes clashes with no column."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(1, text, "en", f"s{i % 7}", i) for i in range(300)] + [(2, text + " x", "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (None, "", "en", "s", 1)]
    runs = []
    for parts in (1, 7):
        kept = keep_one(frame(spark, docs, partitions=parts).withColumn("__row", F.lit(1)).withColumn("row", F.lit(2)).withColumn("node", F.lit(3)))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "__row", "row", "node"]
        runs.append(sorted(map(str, kept.collect())))
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert runs[0] == runs[1]


def test_empty_table(spark):
    assert keep_one(frame(spark, [])).count() == 0


def test_sketches_are_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**64, rng.integers(0, 4000), np.uint64))
        y = np.union1d(x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**64, rng.integers(0, 500), np.uint64))
        apart = sum(int(v).bit_count() for v in (nd.sketch(x) ^ nd.sketch(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


def test_simhash_finds_candidates_first(spark, monkeypatch):
    """The grid links copies with small edits; what it links falsely is dropped by the exact test."""
    met, pairs_of = [], nd._simhash_pairs
    monkeypatch.setattr(nd, "_simhash_pairs", lambda sets: met.append((sets, pairs_of(sets))) or met[-1][1])
    docs = near_documents()
    rng = random.Random(2)
    say = " ".join(f"q{rng.randrange(10**6)}" for _ in range(4000))
    docs += [(3000 + i, edited(say, rng, 1), "en", "s", 1) for i in range(12)]
    kept = keep_one(frame(spark, docs))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want(docs)
    sets, pairs = met[0]
    fps = {r.node: r.fp & (2**64 - 1) for r in sets.collect()}
    found = [(r.src, r.dst) for r in pairs.collect()]
    assert found and all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in found)
    assert len(met) == 1
    monkeypatch.setattr(nd, "_simhash_pairs", lambda sets: sets.alias("a").crossJoin(sets.alias("b")).where("a.node < b.node").select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).limit(500))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in keep_one(frame(spark, docs)).collect()) == want(docs)


def test_folded_sketches_are_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    x = [np.unique(rng.integers(0, 2**64, 300, np.uint64)) for _ in range(2)]
    both = spark.createDataFrame([nd.sketch(s).tolist() for s in x], nd.SKETCH).select(*nd._folded()).collect()
    for s, got in zip(x, both):
        slots = ((s >> np.uint64(24)) & np.uint64(511)).astype(np.int64)
        assert np.array(list(got), np.int64).tolist() == np.packbits((np.bincount(slots, minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def test_of_copies_in_many_chunks_one_posts(spark):
    """No row of a set but one carries shingles, so the table of sets needs no join to find copies."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    docs = [(i, texts[i % 20] if i % 3 else texts[0], "en", "s", 1) for i in range(600)]
    docs += [(1000 + i, edited(t, rng, 1), "en", "s", 1) for i, t in enumerate(texts)]
    rows = nd._nodes(frame(spark, docs, partitions=7), 5, 0.8, "doc_id", "text").collect()
    assert len(rows) == 620
    posts = [r.node for r in rows if r.keys is not None]
    assert len(posts) == len(set(posts)) == len({r.node for r in rows}) == 40


def test_pairs_below_the_bound_meet_about_once(spark, monkeypatch):
    """Texts of a family just below the bound share dozens of posted shingles, and make a row a pair all the same."""
    rng = random.Random(4)
    rows, joined = [], nd._met
    monkeypatch.setattr(nd, "_met", lambda *x: rows.append(joined(*x)) or rows[-1])
    docs = []
    for f in range(3):
        say = " ".join(f"q{f}w{i}" for i in range(300))
        docs += [(100 * f + i, edited(say, rng, rng.choice((4, 9))), "en", "s", 1) for i in range(40)]
    part, _ = classes([d[1] for d in docs])
    kept = sorted(r.doc_id for r in keep_one(frame(spark, docs), leaders=0).collect())
    assert kept == sorted({min(d[0] for d, q in zip(docs, part) if q == p) for p in set(part)})
    pairs = rows[0].count()
    assert rows[0].distinct().count() <= pairs <= 2 * len(docs) ** 2 / 6


def test_near_pairs_meet_in_the_first_shared_list(spark):
    """Pairs at the bound, of which one has its own shingles first and the other is shorter."""
    rng = random.Random(6)
    docs = []
    for f in range(40):
        say = [f"r{f}w{i}" for i in range(rng.randrange(30, 200))]
        cut = rng.randrange(len(say) // 5)
        docs += [(3 * f + k, " ".join(x), "en", "s", 1) for k, x in enumerate((say, say[: len(say) - cut], say[cut // 2 :] + [f"n{f}x{i}" for i in range(cut // 2)]))]
    part, near = classes([d[1] for d in docs])
    assert near > 50
    assert sorted(r.doc_id for r in keep_one(frame(spark, docs), leaders=0, rounds=0).collect()) == sorted({min(d[0] for d, q in zip(docs, part) if q == p) for p in set(part)})
