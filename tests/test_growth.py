"""How often rows are sent, and how finely they are dealt: what decides whether a query keeps pace with its input."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import storage
from cladeframe.operators import align, census, chimera, events, kmers, neighbours, network
from cladeframe.plans import queries as q
from cladeframe.sources import tables

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Exchanges by hash in a plan that has not run yet."""
    return plan(df).count("Exchange hashpartitioning")


def test_pairs_of_best_hits_are_sent_once(spark):
    best = q._best(spark, D)
    assert exchanges(best) - exchanges(q._table(spark, D, "lineitem").select("l_orderkey", "l_partkey").distinct()) <= 6
    assert plan(best).count("hashpartitioning(query") == 1


def test_segments_are_sent_once(spark):
    hits = spark.createDataFrame([(1, 2, 1, 4, 1, "4M", 1)], "query long, target long, qstart int, qend int, sstart int, cigar string, ord int")
    assert exchanges(align.letters(hits)) == 1


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_pairs_across_batches(spark, batch):
    """Segments of a pair in several batches are seen together; null and empty ones leave a row of gaps."""
    rng = random.Random(batch)
    hits = [(x % 3, x % 5, b := rng.randrange(1, 20), b + 5, 1, "6M", o) for o, x in enumerate(rng.randrange(15) for _ in range(60))]
    hits += [(7, 8, None, None, None, None, 1), (7, 9, 3, 2, 1, "4M", 1)]
    df = spark.createDataFrame(hits, "query long, target long, qstart int, qend int, sstart int, cigar string, ord int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.query, r.target): {c: p.t + c - p.c for p in r.parts for c in range(p.c, p.e)} for r in align.letters(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for query, target, a, b, s, _, _ in sorted(hits, key=lambda h: h[6]):
        cells = want.setdefault((query, target), {})
        if a is not None and b >= a:
            cells |= {c: s + c - a for c in range(a, b + 1)}
    assert got == want


def test_alignments_leave_hits_where_they_are(spark):
    """Hits that are dealt by query are cut there; a short row of each is sent, to the targets' sequences."""
    made = plan(q.alignment_rows(spark, D))
    assert len(re.findall(r"hashpartitioning\(query#\d+L?, \d+\), REPARTITION_BY_NUM", made)) == 1
    assert made.count("hashpartitioning(query") == 2 and made.count("hashpartitioning(target") == 2  # the others are widths and sequences
    assert "cladeframe/" not in made  # nothing is written


def rows_of_queries(rng, n):
    """(query, target, parts, width) in order: queries of one row and of many, some with a row of their own."""
    out = []
    for x in range(n):
        width = rng.randrange(12)
        for target in sorted(rng.sample(range(90), rng.choice([1, 2, 3, 40]))):
            cuts = sorted(rng.sample(range(1, 16), 2 * rng.randrange(4)))
            out.append((x, target, [{"c": c, "e": e, "t": rng.choice([1, 300, 70_000]) + c} for c, e in zip(cuts[::2], cuts[1::2])], width))
    return out


@pytest.mark.parametrize("held,batch", [(1, 1), (1, 7), (5, 3), (30, 11), (1 << 15, 13)])
def test_queries_of_any_number_of_rows_are_cut(spark, monkeypatch, held, batch):
    """Queries that are held and those that wait in a file, in batches of any size, against cells and against the tables' good columns."""
    monkeypatch.setattr(align, "HELD", held)
    given, most = rows_of_queries(random.Random(9), 30), 5
    kind = pa.schema([("query", pa.int64()), ("target", pa.int64()), ("parts", pa.list_(pa.struct([(c, pa.int32()) for c in "cet"]))), ("width", pa.int32())])
    table = pa.Table.from_pylist([dict(zip(kind.names, r)) for r in given], kind)
    got = {}
    for b in align._queries(iter(table.to_batches(batch)), 0.7, most):
        row, cut = align._unpack(b.column(3), 3)
        for i, (query, target, size) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            cells = [None] * size
            for at, n, t in cut[row == i].tolist():
                cells[at : at + n] = range(t, t + n)
            assert (query, target) not in got
            got[query, target] = cells
    want, good = {}, {}
    for query in {r[0] for r in given}:
        rows = {t: {c: p["t"] + c - p["c"] for p in parts for c in range(p["c"], p["e"])} for x, t, parts, _ in given if x == query}
        width = next(r[3] for r in given if r[0] == query)
        rows.setdefault(query, {c: c for c in range(1, width + 1)})
        good[query] = [c for c in range(1, width + 1) if sum(c not in r for r in rows.values()) / len(rows) < 0.7][:most]
        want |= {(query, t): [r.get(c) for c in good[query]] for t, r in rows.items() if good[query]}
    assert got == want
    spans = [(x, p["c"], p["e"]) for x, _, parts, _ in given for p in parts] + [(x, 1, w + 1) for x, w in {(r[0], r[3]) for r in given if not any(t == r[0] for y, t, _, _ in given if y == r[0])}]
    sizes = spark.createDataFrame([(x, next(r[3] for r in given if r[0] == x), len({t for y, t, _, _ in given if y == x} | {x})) for x in good], "query long, width int, rows long")
    told = align.first_columns(align.gap_intervals(spark.createDataFrame(spans, "query long, c int, e int"), sizes), most).collect()
    assert {r.query: [c for g in r.good for c in range(g.begin, g.begin + g.size)] for r in told} == {x: c for x, c in good.items() if c}


def test_packed_rows_come_back(spark):
    rng = np.random.default_rng(2)
    for n, high in ((0, 1), (3, 200), (50, 300), (50, 70_000), (50, 2**32 - 1)):
        row = np.sort(rng.integers(0, max(n, 1), 3 * n))
        numbers = rng.integers(0, high, (3 * n, 3)) >> rng.integers(0, 30, (3 * n, 1))
        packed = align._pack(row, numbers, n)
        got = align._unpack(packed, 3)
        assert (got[0] == row).all() and (got[1] == numbers).all()
        if n:
            got = align._unpack(packed.slice(1), 3)
            assert (got[0] == row[row > 0] - 1).all() and (got[1] == numbers[row > 0]).all()


def test_alignments_with_names_that_proteins_lack(spark):
    """They go before gaps are counted, as do those without a sequence; null names go too."""
    hits = [(1, 2, 1, 3, 1, "3M", 1), (1, 7, 1, 3, 1, "3M", 1), (1, 3, 1, 3, 1, "3M", 1), (1, 4, 2, 3, 1, "2M", 1), (7, 1, 1, 3, 1, "3M", 1), (3, 1, 1, 3, 1, "3M", 1), (2, 7, 1, 1, 1, "1M", 1), (None, 1, 1, 3, 1, "3M", 1), (1, None, 1, 3, 1, "3M", 1), (4, 2, None, None, None, None, 1)]
    df = spark.createDataFrame(hits, "query long, target long, qstart int, qend int, sstart int, cigar string, ord int")
    protein = spark.createDataFrame([(1, "ABC"), (2, "DEF"), (3, None), (4, "GH"), (5, "")], "protein_id long, seq string")
    want = {(1, 1, "ABC"), (1, 2, "DEF"), (1, 4, "-GH"), (4, 4, "GH"), (4, 2, "--")}
    assert {tuple(r) for r in align.alignments(df, protein).collect()} == want
    told = df.where("coalesce(target, 0) NOT IN (3, 7)")
    assert {tuple(r) for r in align.alignments(told, protein, known=True).collect()} == want


def test_pairs_are_dealt_by_rows(spark, monkeypatch):
    """The partitions in which pairs are made follow the rows, not their bytes, and the counts stay."""
    groups = spark.createDataFrame([(i % 50, i // 50) for i in range(500)], "query long, member long")
    want = sorted(map(tuple, events.member_pairs(groups, "member").collect()))
    monkeypatch.setattr(events, "ROWS", 10)
    got = events.member_pairs(groups, "member")
    assert got.rdd.getNumPartitions() >= 50
    assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "query long, leaf long, ortho boolean")
    assert {r.n_ortho for r in events.pair_counts(none, groups).collect()} == {50}
    assert events.pair_counts(none, groups.limit(0)).count() == 0


def test_hits_on_no_edge_read_the_pairs_once(spark):
    assert plan(q.other_hits(spark, D)).count("FileScan parquet [l_orderkey") == 2


def test_hits_between_communities_are_not_sent(spark):
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 8)], "id long, og long")
    edges = spark.createDataFrame([(1, 2, 9), (1, 5, 9), (2, 1, None)], "src long, dst long, qend int")
    others = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (2, 3), (3, 5)], "query long, target long")
    out = chimera.supported(members, edges, others)
    assert not re.search(r"hashpartitioning\(id#\d+L?, k#", plan(out))
    assert sorted(map(tuple, out.collect())) == [(1, 7), (5, 8)]


def test_communities_are_chosen_before_their_links_move(spark, monkeypatch):
    """What is able is written, and a community is able by its links and by its species."""
    written = []
    monkeypatch.setattr(chimera, "materialize", lambda df, name: (written.append(name), storage.materialize(df, name))[1])
    found = spark.createDataFrame([(i, 0, 7 if i < 5 else 8, True) for i in range(10)], "id long, component long, og long, split boolean")
    species = spark.createDataFrame([(i, i % 2 if i < 5 else 3) for i in range(10)], "id long, species int")
    spans = [(0, i, 1, 10) for i in range(1, 5)] + [(0, i, 50, 60) for i in range(5, 10)] + [(5, i, 1, 9) for i in range(6, 10)] + [(5, i, 20, 29) for i in range(5)]
    edges = spark.createDataFrame(spans, "src long, dst long, qstart int, qend int")
    assert sorted(map(tuple, chimera.chimeras(found, edges, species, 1, 0.5).collect())) == [(0, 8), (5, 7)]
    assert chimera.chimeras(found, edges, species, 2, 0.5).count() == 0
    assert "communities-able" in written


def test_kmers_are_sent_in_few_bytes():
    """Packed numbers come back as they were, and an entry of 2 million takes 13 bytes at most (32 before)."""
    rng = np.random.default_rng(1)
    for x in ([0], [5], [-3, 7], [2**62, 1, 0], rng.integers(-(2**63), 2**63 - 1, 50)):
        x = np.array(x, np.int64)
        assert kmers._wide(pa.py_buffer(kmers._narrow(x)), len(x)).view(np.int64).tolist() == x.tolist()
    h = np.unique(rng.integers(0, 2 ** kmers.SENT[0], kmers.HELD, np.uint64))
    packed = kmers._gaps(h)
    assert (kmers._from_gaps(pa.py_buffer(packed), len(h)) == h).all()
    assert (kmers._from_gaps(pa.py_buffer(kmers._gaps(h[:1])), 1) == h[:1]).all()
    rest = [rng.integers(0, 2 ** kmers.SENT[1], len(h), np.int64), rng.integers(0, 6_000_000, len(h), np.int64), np.ones(len(h), np.int64)]
    assert len(packed) + sum(len(kmers._narrow(x)) for x in rest) <= 13 * len(h) + 8


def texts_of_pieces(rng, n, letters="ACDEFGHIKLMNOPQRSTUVWXY*é"):
    """Pieces that texts share at both ends or inside, some twice in a text or periodic, and whole copies."""
    base = ["".join(rng.choice(letters) for _ in range(90)) for _ in range(4)] + ["ACDEFGHIKL" * 9]
    piece = lambda: base[rng.randrange(5)][rng.randrange(40) : rng.randrange(45, 91)]
    made = ["".join(piece() for _ in range(rng.randrange(4))) for _ in range(n)]
    return made + made[:10] + [base[0], base[0], "AC", ""]


@pytest.mark.parametrize("seed", [1, 4, 40])
def test_kmers_by_parts_against_brute_force(spark, monkeypatch, seed):
    """Shared k-mers, how many texts have them and the clusters, whether few, many or all parts of a name differ."""
    monkeypatch.setattr(kmers, "SEED", seed)
    rng, k, distinct = random.Random(seed), 14, 6
    seqs = [(i, rng.choice([0, 1, None]), s) for i, s in enumerate(texts_of_pieces(rng, 50))]
    want, sets = {}, {}
    for i, g, s in seqs:
        sets[i] = {s[j : j + k] for j in range(len(s) - k + 1)}
        sets[i] = {x for x in sets[i] if len(set(x)) >= distinct and not set(x) & set("X*")}
        want.setdefault(g, collections.Counter()).update(sets[i])
    df = spark.createDataFrame(seqs, "protein_id long, species_id int, seq string").repartition(5)
    got = {r.grp: (r.n_shared, r.n_postings) for r in kmers.shared_kmers(df, k, distinct).collect()}
    assert got == {g: (sum(v > 1 for v in c.values()), sum(v for v in c.values() if v > 1)) for g, c in want.items() if c}
    comp = {i: i for i in sets}
    for _ in seqs:
        for (a, g, _), (b, h, _) in itertools.combinations(seqs, 2):
            if g == h and sets[a] & sets[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
    rep = {c: max((x for x in comp if comp[x] == c), key=lambda x: (len(seqs[x][2]), -x)) for c in comp.values()}
    assert {(r.rep_id, r.member_id) for r in kmers.kmer_clusters(df, k, distinct).collect()} == {(rep[c], x) for x, c in comp.items()}


def test_kmers_of_a_text_travel_as_parts(spark, monkeypatch):
    """A text's own k-mers, and those of texts that are copies, cost less than a byte each (some ten before)."""
    rng = random.Random(7)
    own = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(4000)) for _ in range(40)]
    sent, met = [], kmers._met
    monkeypatch.setattr(kmers, "_met", lambda packed, parts: (sent.append(packed), met(packed, parts))[1])
    df = spark.createDataFrame(list(enumerate(own + own[:20])), "protein_id long, seq string").withColumn("species_id", F.lit(1))
    assert [tuple(r) for r in kmers.shared_kmers(df.coalesce(1)).collect()] == [(1, 20 * 3901, 40 * 3901)]
    assert len(sent) == 1  # no name has several parts
    assert sent[0].select(F.sum(sum(F.length(c) for c in kmers.PACKED))).first()[0] < 60 * 3901


def test_parts_are_dealt_by_their_number(spark, monkeypatch):
    """What one task reads of parts, k-mers and texts doesn't grow with the input."""
    asked, dealt = [], kmers.dealt_into
    monkeypatch.setattr(kmers, "dealt_into", lambda spark, n: (asked.append(n), dealt(spark, n))[1])
    monkeypatch.setattr(kmers, "DEALT", 8)
    text = "".join(random.Random(3).choices("ACDEFGHIKLMNPQRSTVWY", k=1000))
    df = spark.createDataFrame([(1, 0, text), (2, 0, text[130:] + "AC"), (3, 0, text)], "protein_id long, species_id int, seq string")
    assert [tuple(r) for r in kmers.shared_kmers(df).collect()] == [(0, 901, 2 * 901 + 771)]
    assert len(asked) == 2 and asked[0] >= 2900 // 31 // 8 - 1 and asked[1] >= 10


def test_lines_of_orders_are_dealt_by_rows(spark):
    """What one task holds of the lines of orders doesn't grow with them."""
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, \d+\), REPARTITION_BY_NUM", plan(q._best(spark, D)))
    cores = spark.sparkContext.defaultParallelism
    assert q._partitions(spark, spark.range(1 << 10)) == (cores, cores) and q._partitions(spark, spark.range(1 << 25)) == (64, 256)

def test_census_moves_a_row_a_query_and_species(spark):
    """Hits that tell their species aren't dealt again, and are read once."""
    best, whole = q._best(spark, D), q.hit_census(spark, D)
    assert exchanges(whole) - exchanges(best) <= 1
    assert plan(whole).count("Window ") == plan(best).count("Window ")

@pytest.mark.parametrize("told", [False, True])
def test_census_against_brute_force(spark, told):
    """Repeated hits, hits on itself, targets and queries without a species, null ones."""
    rng = random.Random(4)
    of = {i: rng.choice(["a", "b", "c", None]) for i in range(30)}
    hits = [(rng.randrange(35), rng.randrange(36)) for _ in range(300)] + [(40, 41), (42, 1), (43, 43), (None, 1), (None, 2), (50, None), (3, 3), (3, 3)]
    want = {}
    for query, target in hits:
        want.setdefault(query, set()).update({target, query} & set(of))
    if told:
        hits = [(a, b, of[b]) for a, b in hits if b in of]
        want = {a: want[a] for a, _, _ in hits}
    df = spark.createDataFrame(hits, "query long, target long" + (", species string" if told else ""))
    got = {r.query: (r.n_members, r.n_present, r.n_dupli) for r in census.hit_census(df, spark.createDataFrame(list(of.items()), "id long, species string")).collect()}
    counts = {k: [sum(of[m] == s for m in v) for s in {of[m] for m in v}] for k, v in want.items() if v}
    assert got == {k: (sum(c), len(c), sum(n > 1 for n in c)) for k, c in counts.items()}

def test_hits_are_sent_without_the_names_of_files(spark, tmp_path):
    """Their order follows the files' names, odd ones too."""
    for k, name in enumerate(["b 1%.tsv", "a+ü.tsv", "c.tsv"]):
        (tmp_path / name).write_text("".join(f"1\t2\t{10 * k + i}\t99\t1\t7M\n" for i in range(3)))
    hits = tables.read_hits(spark, str(tmp_path))
    assert "BroadcastHashJoin" in plan(hits)
    assert [r.qstart for r in sorted(hits.collect(), key=lambda r: r.ord)] == [10, 11, 12, 0, 1, 2, 20, 21, 22]

@pytest.mark.parametrize("cell", [1 << 21, 8])
def test_pairs_of_neighbours_are_not_sent(spark, monkeypatch, cell):
    """Pairs of neighbours meet the edges in cells; repeated edges, hubs, negative and large ids."""
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "LISTS", 7)
    rng = random.Random(cell)
    names = [rng.randrange(-(2**63), 2**63) for _ in range(60)]
    und = {tuple(sorted(rng.sample(names, 2))) for _ in range(400)} | {tuple(sorted((names[0], x))) for x in names[1:]}
    edges = sorted(und) + [(b, a) for a, b in und]
    df = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    out = network.clustering(None, df, 6)
    assert "LeftSemi" not in plan(out)
    got, have = {r.id: (r.degree, r.lcc) for r in out.collect()}, set(edges)
    assert set(got) == {a for a, _ in edges}
    most, top = network.lcc_limits(6)
    for v, (degree, lcc) in got.items():
        near = sorted(b for a, b in edges if a == v)
        nb = top if len(near) > most else len(near) * (len(near) - 1)
        found = sum((x, y) in have for i, x in enumerate(near[:most]) for y in near[i + 1 : most])
        assert degree == len(near) and abs(lcc - (2 * found / nb if degree >= 4 else 0)) < 1e-5
    assert network.clustering(None, df.limit(0), 6).count() == 0
