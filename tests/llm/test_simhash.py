import random

import numpy as np
import xxhash
from fixtures import LOWER, documents, frame, words
from pyspark.sql import functions as F

from cladeframe.llm.simhash import _grid, counts_code, fingerprints, grid_blocks, grid_masks, hex_fingerprint, keep_one, near_duplicates, near_links
from cladeframe.operators.components import connected_components

M = (1 << 64) - 1


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_against_brute_force(spark):
    docs = documents()
    values = [fingerprint(d[1]) for d in docs]
    part = classes(values)
    least = {}
    for (i, *_), p in zip(docs, part):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = sorted(((i, f"{v:016x}", least.get(p)) for (i, *_), v, p in zip(docs, values, part)), key=str)
    have = near_duplicates(frame(spark, docs)).select("doc_id", hex_fingerprint(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, have), key=str) == want


def test_code_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(x := rng.getrandbits(64), x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))) for _ in range(300)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    masks = grid_masks()
    for (a, b), r in zip(pairs, df.select(counts_code(F.col("a")).alias("x"), counts_code(F.col("b")).alias("y")).collect()):
        manhattan = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        x, y = r.x & M, r.y & M
        assert (x ^ y).bit_count() == manhattan <= (a ^ b).bit_count()
        if (a ^ b).bit_count() <= 2:
            assert any((x & m & M) == (y & m & M) for m in masks)


def test_dense_cells_link_as_pairs_do(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    part = classes(values)
    want = {(values[i], values[p]) for i, p in enumerate(part) if part.count(p) > 1}
    for dense, blocks in ((0, None), (5, None), (10_000, None), (10_000, 8)):
        links = near_links(df, 2, dense, blocks)
        assert all((r.src ^ r.dst).bit_count() <= 2 for r in links.collect())
        assert {tuple(r) for r in connected_components(links).collect()} == want


def test_crowded_cells_are_refined(spark):
    """A cell of 500 fingerprints and more: all links that are pairs come from the grid, and components are as by brute force."""
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    high = ((1 << 63) - 1) >> 26 << 26  # the cell: equal in three blocks of the coarsest grid
    values = sorted({centre & high | rng.getrandbits(26) for _ in range(700)} | {centre & high | (centre ^ (1 << a) ^ (1 << b)) & ~high & (1 << 63) - 1 for a in range(12) for b in range(12)})
    assert len(values) > 700
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    part = classes(values)
    want = {(values[i], values[p]) for i, p in enumerate(part) if part.count(p) > 1}
    for dense in (64, 2):
        links = near_links(df, 2, dense, 5)
        assert {tuple(r) for r in connected_components(links).collect()} == want
    pairs = {(a, b) for i, b in enumerate(values) for a in values[:i] if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(r)) for r in near_links(df, 2, 64, 5).collect()} == pairs  # nothing was left to the balls
    near, crowd = _grid(df, 2, 64, 5)
    assert crowd.count() > 500 and near.count() < len(pairs)
    for d in (0, 1):
        got = {tuple(sorted(r)) for r in near_links(df, d, 2, 5).collect()}
        assert got == {p for p in pairs if (p[0] ^ p[1]).bit_count() <= d}


def test_blocks_grow_with_the_fingerprints():
    got = [grid_blocks(10**k) for k in range(4, 13)]
    assert got[0] == 5 and got == sorted(got) and got[-1] >= 9


def test_long_texts_and_many_shingles():
    t = " ".join(f"w{i % 977}x{i}" for i in range(150_000))
    from cladeframe.llm.simhash import _fingerprints

    assert [int(x) for x in _fingerprints([t.encode(), None, b"", b"a b", t.encode()], 3, 42)] == [fingerprint(t), 0, 0, fingerprint("a b"), fingerprint(t)]
    assert np.array_equal(_fingerprints([], 3, 42), np.zeros(0))


def test_keep_one(spark):
    docs = documents()
    part = classes([fingerprint(d[1]) for d in docs])
    kept = keep_one(frame(spark, docs).withColumn("row", F.lit(1)).withColumn("__row", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "__row"]
    rows = kept.collect()
    assert len(rows) == len(set(part))
    want = sorted((min((d[0] is None, d[0] or 0) for d, q in zip(docs, part) if q == p) for p in set(part)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == want
    assert keep_one(frame(spark, [])).count() == 0 and near_duplicates(frame(spark, [])).count() == 0


def test_repeated_rows(spark):
    docs = [(1, "a b c d", "en", f"s{i % 3}", i) for i in range(200)] + [(2, "A b c d", "en", "s", 1), (None, None, "", "", 0), (None, "", "", "", 0)]
    runs = [sorted(map(str, keep_one(frame(spark, docs, partitions=p)).collect())) for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 2
    assert near_duplicates(frame(spark, docs)).count() == len(docs)


def test_fingerprints_keep_every_row(spark):
    docs = documents()
    assert fingerprints(frame(spark, docs)).count() == len(docs)
