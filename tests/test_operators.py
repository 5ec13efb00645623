import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions.indexing import with_index
from cladeframe.functions.medians import exact_medians
from cladeframe.functions.strings import expand_hsp, kmers, valid_kmer
from cladeframe.operators import align, census, chimera, communities, events, network, reports, search, trees
from cladeframe.operators.components import connected_components
from cladeframe.operators.kmers import kmer_clusters, rolling_kmers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(parent))


# ---- strings


def test_kmers_and_validity(spark):
    df = spark.createDataFrame([("ABCD",), ("AB",), ("",), (None,)], "s string").select(kmers(F.col("s"), 3).alias("k"))
    assert [r[0] for r in df.collect()] == [["ABC", "BCD"], [], [], []]
    ok = spark.createDataFrame([("ABC",), ("ABA",), ("ABX",), ("AB*",), ("abx",)], "s string").select(valid_kmer(F.col("s"), 3)).collect()
    assert [r[0] for r in ok] == [True, False, False, False, True]


@pytest.mark.parametrize("start,cigar,want", [(3, "2M3I4M", "CD---EFGH"), (1, "2M3D4M", "ABFGHI"), (1, "5M", "ABCDE"), (1, "2M2X2M", "ABCD")])
def test_expand_hsp(spark, start, cigar, want):
    got = spark.range(1).select(expand_hsp(F.lit("ABCDEFGHIJ"), F.lit(start), F.lit(cigar))).first()[0]
    assert got == want


# ---- components


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (60, 80), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges = [e for e in edges if e[0] != e[1]] or [(1, 2)]
        got = rows(connected_components(spark.createDataFrame(edges + [(7, 7)], "src long, dst long")))
        assert got == union_find(edges)


def test_components_of_a_chain_a_star_strings_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    assert {r[1] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()} == {0}
    star = [(500, i) for i in range(100)] + [(500, 1)]
    assert {r[1] for r in connected_components(spark.createDataFrame(star, "src long, dst long")).collect()} == {0}
    words = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", None), ("z", "y")], "src string, dst string")
    assert rows(connected_components(words)) == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- k-mers


def brute_clusters(seqs, k, m):
    sets = {}
    for i, (g, s) in seqs.items():
        sets[i] = {s[j : j + k] for j in range(len(s) - k + 1)}
        sets[i] = {x for x in sets[i] if len(set(x)) >= m and "X" not in x and "*" not in x}
    edges = [(a, b) for a, b in itertools.combinations(sorted(seqs), 2) if seqs[a][0] == seqs[b][0] and sets[a] & sets[b]]
    comp = dict(union_find(edges))
    groups = {}
    for i in seqs:
        groups.setdefault(comp.get(i, i), []).append(i)
    return sorted((max(g, key=lambda i: (len(seqs[i][1]), -i)), i, seqs[i][0]) for g in groups.values() for i in g)


def test_kmer_clusters_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFGHIKLMX*é") for _ in range(40)) for _ in range(5)]
    seqs = {i: (i % 3, base[rng.randrange(5)][rng.randrange(10) : rng.randrange(20, 41)]) for i in range(60)}
    seqs[60] = (0, "")
    df = spark.createDataFrame([(i, g, s) for i, (g, s) in seqs.items()], "protein_id long, species_id int, seq string")
    assert rows(kmer_clusters(df, 8, 5)) == brute_clusters(seqs, 8, 5)


def test_shared_kmers_against_brute_force(spark):
    from collections import Counter

    from cladeframe.operators import kmers as module

    rng = random.Random(6)
    base = ["".join(rng.choice("ACDEFGHIKLM") for _ in range(60)) for _ in range(4)]
    seqs = [(i, rng.choice([0, 1, None]), base[rng.randrange(4)][rng.randrange(20) :]) for i in range(80)]
    want: dict = {}
    for _, g, s in seqs:
        want.setdefault(g, Counter()).update({s[j : j + 12] for j in range(len(s) - 11) if len(set(s[j : j + 12])) >= 6})
    df = spark.createDataFrame(seqs, "protein_id long, species_id int, seq string").repartition(5)
    got = {r.grp: (r.n_shared, r.n_postings) for r in module.shared_kmers(df, 12, 6).collect()}
    assert got == {g: (sum(v > 1 for v in c.values()), sum(v for v in c.values() if v > 1)) for g, c in want.items()}


def test_a_chain_of_kmers_and_a_tie(spark):
    a, b, c = "ABCDEFGH", "EFGHIJKL", "IJKLMNOP"
    df = spark.createDataFrame([(3, 0, a), (2, 0, b), (1, 0, c), (0, 0, "AAAAAAAA"), (4, 1, a), (5, 0, None)], "protein_id long, species_id int, seq string")
    assert rows(kmer_clusters(df, 4, 3)) == [(0, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 0), (4, 4, 1), (5, 5, 0)]


def test_rolling_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    s = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(300))
    one = set(zip(*rolling_kmers(s[100:220], 100, 5, "X*")))
    assert one <= set(zip(*rolling_kmers(s, 100, 5, "X*"))) and len(one) == 21
    assert len(rolling_kmers("A" * 200, 100, 2, "X*")[0]) == 0


# ---- census


def test_census_routes(spark):
    species = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 1)], "id long, species int")
    hits = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 3), (3, 1), (3, 2), (4, 1), (4, 1), (4, 2), (4, 3), (5, 5)], "query long, target long")
    got = {r["query"]: (r.n_members, r.n_present, r.n_dupli, r.has_tree) for r in census.hit_census(hits, species).collect()}
    assert got == {1: (2, 2, 0, False), 2: (2, 1, 1, False), 3: (3, 2, 1, True), 4: (4, 3, 1, True), 5: (1, 1, 0, False)}
    routed, none = census.route(hits, census.hit_census(hits, species))
    assert {r[0] for r in routed.collect()} == {3, 4}
    assert rows(none) == [(1, 1), (1, 3), (2, 1), (2, 2), (5, 5)]


def test_top_per_group_breaks_ties(spark):
    df = spark.createDataFrame([(1, 9, "a", 5.0), (1, 8, "a", 5.0), (1, 7, "a", 4.0), (1, 6, "b", 1.0)], "query long, target long, species string, score double")
    got = census.top_per_group(df, 2, ["query", "species"], "score", "target")
    assert sorted(r["target"] for r in got.collect()) == [6, 8, 9]


# ---- alignments and trees


def splice(length, segments):
    """A target's row: gaps, overwritten by each segment (first column from 1, characters) in turn."""
    row = ["-"] * length
    for start, piece in segments:
        row[start - 1 : start - 1 + len(piece)] = piece
    return "".join(row[:length])


def brute_alignments(hits, seqs, max_gap, most):
    import re

    own = {}
    for q, t, qs, qe, ss, cigar, _ in sorted(hits, key=lambda h: h[6]):
        at, piece = ss - 1, ""
        for n, op in re.findall(r"(\d+)([MID])", cigar):
            piece += seqs[t][at : at + int(n)] if op == "M" else "-" * int(n) if op == "I" else ""
            at += int(n) if op in "MD" else 0
        own.setdefault(q, {}).setdefault(t, []).append((qs, piece))
    out = []
    for q, targets in own.items():
        made = {t: splice(len(seqs[q]), s) for t, s in targets.items()}
        made.setdefault(q, seqs[q])
        good = [i for i in range(len(seqs[q])) if sum(r[i] == "-" for r in made.values()) / len(made) < max_gap][:most]
        out += [(q, t, "".join(r[i] for i in good)) for t, r in made.items() if good]
    return sorted(out)


@pytest.mark.parametrize("seed,max_gap,most", [(1, 0.7, 4988), (2, 0.3, 4988), (3, 0.7, 9)])
def test_alignments_against_brute_force(spark, seed, max_gap, most):
    rng = random.Random(seed)
    seqs = {i: "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(8, 60))) for i in range(12)}
    hits = []
    for q in range(8):
        for t in rng.sample(range(12), rng.randrange(1, 7)):
            for n in range(rng.choice([1, 1, 2, 4])):
                qs, ss = rng.randrange(1, len(seqs[q]) - 5), rng.randrange(1, len(seqs[t]) - 5)
                parts, c, at = "", 0, 0
                while len(seqs[q]) - qs - c > 3 and len(seqs[t]) - ss - at > 3 and rng.random() < 0.8:
                    op = rng.choice("MMMID")
                    k = rng.randrange(1, 4)
                    parts += f"{k}{op}"
                    c, at = c + k * (op in "MI"), at + k * (op in "MD")
                if c:
                    hits.append((q, t, qs, qs + c - 1, ss, parts, n + 1))
    df = spark.createDataFrame(hits, "query long, target long, qstart int, qend int, sstart int, cigar string, ord int").repartition(3)
    protein = spark.createDataFrame([(i, 0, "p", s) for i, s in seqs.items()], "protein_id long, species_id int, name string, seq string")
    assert rows(align.alignments(df, protein, max_gap, most)) == brute_alignments(hits, seqs, max_gap, most)


def test_columns_are_cut_at_the_limit_and_the_share_of_gaps_is_strict(spark):
    sizes = spark.createDataFrame([(1, 6000, 10), (2, 3, 10), (3, 5, 1)], "query long, width int, rows long")
    filled = [(1, 1, 6001)] * 10 + [(2, 1, 2)] * 3 + [(2, 2, 3)] * 4
    spans = align.gap_intervals(spark.createDataFrame(filled, "query long, c int, e int"), sizes)
    got = {(r.query, r.begin): (r.stop, r.gaps, r.good) for r in spans.collect()}
    assert got == {(1, 1): (6001, 0, True), (2, 1): (2, 7, False), (2, 2): (3, 6, True), (2, 3): (4, 10, False), (3, 1): (6, 1, False)}
    assert {r.query: [tuple(g) for g in r.good] for r in align.first_columns(spans).collect()} == {1: [(1, 4988)], 2: [(2, 1)]}


def test_alignments(spark):
    protein = spark.createDataFrame([(1, 0, "a", "ABCDEFGH"), (2, 1, "b", "CDEFGH"), (3, 1, "c", "ABXX")], "protein_id long, species_id int, name string, seq string")
    hits = spark.createDataFrame(
        [(1, 2, 3, 6, 1, "4M", 1), (1, 2, 5, 8, 3, "4M", 2), (1, 3, 1, 2, 1, "2M", 1)], "query long, target long, qstart int, qend int, sstart int, cigar string, ord int"
    )
    assert rows(align.alignments(hits, protein, 0.7)) == [(1, 1, "ABCDEFGH"), (1, 2, "--CDEFGH"), (1, 3, "AB------")]
    assert rows(align.alignments(hits, protein, 0.3)) == []


def additive_distances(tree):
    names, paths = [], {}

    def walk(n, path):
        for c in n.children:
            walk(c, path + [(id(c), c.length)])
        if not n.children:
            names.append(n.name)
            paths[n.name] = dict(path)

    walk(tree, [])
    d = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            pa, pb = paths[a], paths[b]
            d[i, j] = sum(v for k, v in pa.items() if k not in pb) + sum(v for k, v in pb.items() if k not in pa)
    return names, d


def splits(tree, names):
    out, every = set(), frozenset(names)

    def walk(n):
        own = frozenset([n.name]) if not n.children else frozenset().union(*(walk(c) for c in n.children))
        if 1 < len(own) < len(every) - 1:
            out.add(min(own, every - own, key=lambda s: (len(s), sorted(s))))
        return own

    walk(tree)
    return out


def test_neighbour_joining_recovers_additive_trees():
    rng = random.Random(2)
    for n in (3, 4, 7, 12):
        nodes = [trees.Node(str(i), rng.uniform(0.1, 1)) for i in range(n)]
        while len(nodes) > 3:
            i, j = sorted(rng.sample(range(len(nodes)), 2))
            b, a = nodes.pop(j), nodes.pop(i)
            nodes.append(trees.Node("", rng.uniform(0.1, 1), [a, b]))
        true = trees.Node("", 0.0, nodes)
        names, d = additive_distances(true)
        got = trees.neighbour_joining(names, d)
        assert splits(got, names) == splits(true, names)
        assert np.allclose(additive_distances(got)[1], d[np.ix_([names.index(x) for x in additive_distances(got)[0]], [names.index(x) for x in additive_distances(got)[0]])])
        rooted = trees.midpoint_root(got)
        order, e = additive_distances(rooted)
        assert splits(rooted, names) == splits(true, names)
        depth = [max(_depths(c)) + c.length for c in rooted.children]
        assert len(rooted.children) == 2 and abs(depth[0] - depth[1]) < 1e-9 and abs(sum(depth) - e.max()) < 1e-9


def _depths(n):
    return [0.0] if not n.children else [c.length + x for c in n.children for x in _depths(c)]


def test_newick_round_trip_and_ladders(spark):
    t = trees.parse_newick("((1:0.1,2:0.2)x:0.3,(3:1,(4,5)));")
    assert trees.to_newick(trees.parse_newick(trees.to_newick(t))) == trees.to_newick(t)
    assert dict(trees.ladder(t, "1")) == {"1": 0, "2": 1, "3": 2, "4": 2, "5": 2}
    assert dict(trees.ladder(t, "4")) == {"4": 0, "5": 1, "3": 2, "1": 3, "2": 3}
    assert trees.ladder(t, "9") == []
    with pytest.raises(ValueError):
        trees.parse_newick("((1,2);")
    df = spark.createDataFrame([(1, "((1,2),3);"), (3, "((1,2),3);")], "query long, newick string")
    assert rows(trees.ladders(df)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 2, 1), (3, 3, 0)]


# ---- search


def test_local_alignment_against_dynamic_programming():
    m = search.scores()
    rng = random.Random(4)
    for _ in range(40):
        a = "".join(rng.choice("ACDW") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ACDW") for _ in range(rng.randrange(1, 14)))
        best = brute_local(a, b, m)
        got = search.local_alignment(a, b, m)
        if best <= 0:
            assert got is None
            continue
        score, qs, qe, ss, cigar = got
        assert score == best == score_of(a, b, m, qs, ss, cigar, qe)


def test_batches_of_alignments_are_as_single_ones():
    m = search.scores()
    rng = random.Random(9)
    say = lambda: "".join(rng.choice("ACDWKX*") for _ in range(rng.randrange(0, 25)))
    pairs = [(say(), say()) for _ in range(60)]
    old, search.CELLS = search.CELLS, 2000
    try:
        many = search.align_all(pairs, m)
    finally:
        search.CELLS = old
    assert many == search.align_all(pairs, m) == [search.align_all([p], m)[0] for p in pairs]
    assert [x[0] if x else 0 for x in many] == [brute_local(a, b, m) for a, b in pairs]


def brute_local(a, b, m):
    low = -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - 12, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 12, f[i][j - 1] - 1)
            h[i][j] = max(0, h[i - 1][j - 1] + m[ord(a[i - 1]), ord(b[j - 1])], e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def score_of(a, b, m, qs, ss, cigar, qe):
    import re

    i, j, s = qs - 1, ss - 1, 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            s += sum(m[ord(a[i + k]), ord(b[j + k])] for k in range(n))
            i, j = i + n, j + n
        else:
            s -= 11 + n
            i, j = (i + n, j) if op == "I" else (i, j + n)
    assert i == qe
    return s


def mutated(rng, seq, share):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    out = []
    for c in seq:
        x = rng.random()
        if x < share * 0.9:
            out.append(rng.choice(letters))
        elif x < share * 0.95:
            continue
        elif x < share:
            out.append(c + rng.choice(letters))
        else:
            out.append(c)
    return "".join(out)


# Usual shares of amino acids, in thousandths.
COMPOSITION = {"A": 78, "R": 51, "N": 45, "D": 54, "C": 19, "Q": 43, "E": 63, "G": 74, "H": 22, "I": 51, "L": 90, "K": 57, "M": 22, "F": 39, "P": 52, "S": 71, "T": 58, "W": 13, "Y": 32, "V": 64}


def test_constants_of_the_e_value_belong_to_the_matrix():
    rng = np.random.default_rng(3)
    p = np.array(list(COMPOSITION.values())) / sum(COMPOSITION.values())
    n, pairs = 150, 1500
    seqs = ["".join(rng.choice(list(COMPOSITION), n, p=p)) for _ in range(2 * pairs)]
    best = np.array([x[0] for x in search.align_all(list(zip(seqs[::2], seqs[1::2])), search.scores())], float)
    rate = np.pi / np.sqrt(6 * best.var())
    assert abs(rate - search.LAMBDA) < 0.05
    # as many unrelated pairs as the e-value says reach a score
    for score in (24, 27):
        want = 1 - np.exp(-search.K * n * n * np.exp(-search.LAMBDA * score))
        assert abs((best >= score).mean() - want) < 0.35 * want + 0.01


def test_recall_of_seeds_against_dynamic_programming(spark):
    """Of the pairs that full dynamic programming finds significant, at least nine in ten share two seeds on a band."""
    rng = random.Random(12)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    seqs = []
    for _ in range(12):
        parent = "".join(rng.choice(letters) for _ in range(rng.randrange(120, 260)))
        seqs += [mutated(rng, parent, share) for share in (0.0, 0.2, 0.3, 0.4)]
    m = search.scores()
    pairs = list(itertools.combinations(range(len(seqs)), 2))
    made = search.align_all([(seqs[a], seqs[b]) for a, b in pairs], m)
    space = lambda a, b: len(seqs[a]) * sum(map(len, seqs))
    true = {p for p, x in zip(pairs, made) if x and search.K * space(*p) * np.exp(-search.LAMBDA * x[0]) <= 0.001}
    protein = spark.createDataFrame([(i, 0, str(i), s) for i, s in enumerate(seqs)], "protein_id long, species_id int, name string, seq string")
    found = {(r.query, r.target) for r in search.candidates(protein).collect()}
    assert len(true) > 50 and len(true & found) >= 0.9 * len(true)
    assert {(i, i) for i in range(len(seqs))} <= found


def test_a_seed_in_every_row_costs_linear_work(spark):
    """A motif in all rows is told apart by what follows it: lists stay short and no chance pairs are made."""
    rng = random.Random(5)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    n = 1500
    seqs = [say(30) + "MKTAYWQ" + say(40) for _ in range(n)]
    protein = spark.createDataFrame([(i, 0, "p", s) for i, s in enumerate(seqs)], "protein_id long, species_id int, name string, seq string")
    posts = search.seed_postings(protein, hot=50)
    assert posts.groupBy("key").count().agg(F.max("count")).first()[0] <= 50
    per = posts.groupBy("protein_id", "pos").count().agg(F.max("count"), F.count("*")).first()
    seen = sum(len(set(x[i : i + 5])) >= 3 for x in seqs for i in range(len(x) - 4))
    assert per[0] == 1 and per[1] == seen  # every place that isn't masked, once
    assert search.candidates(protein, hot=50).count() < 3 * n


def test_masked_seeds_and_long_ones_at_a_sequence_end(spark):
    protein = spark.createDataFrame([(i, 0, "p", s) for i, s in enumerate(["AAAAAAAAAAACDEFG", "AAAAAAAAAAACDEFG", "KLMNPCDEFGHX", None, "ACD"])], "protein_id long, species_id int, name string, seq string")
    got = rows(search.candidates(protein, hot=1))
    assert got == [(i, i) for i in range(5)][:1] + [(0, 1)] + [(i, i) for i in range(1, 5)]


# ---- events


def walk_last_good(leaves, limit):
    """Independent walk over steps with sets; leaves: (leaf, step, species)."""
    browsed = {s for _, k, s in leaves if k == 0}
    good = 0
    for k in range(1, max(k for _, k, _ in leaves) + 1):
        sister = {s for _, x, s in leaves if x == k}
        if not sister:
            continue
        both = browsed & sister
        if len(browsed | sister) == 1 or (len(both) / len(sister) <= limit and len(both) / len(browsed) <= limit):
            good = k
        browsed |= sister
    return good


LADDER = "query long, leaf long, step int, species string"


@pytest.mark.parametrize(
    "leaves,good",
    [
        ([(1, 0, "A"), (2, 1, "B"), (3, 2, "A"), (4, 3, "C")], 3),  # fails, then passes
        ([(1, 0, "A"), (2, 1, "A"), (3, 1, "B")], 0),
        ([(1, 0, "A"), (2, 1, "A")], 1),  # one species
        ([(1, 0, "A"), (2, 1, "B"), (3, 2, "A"), (4, 2, "C")], 2),  # a ratio of exactly one half
    ],
)
def test_last_good(spark, leaves, good):
    df = spark.createDataFrame([(1, *x) for x in leaves], LADDER)
    assert rows(events.last_good(df)) == [(1, good)]


def random_ladders(rng, n):
    out = []
    for q in range(n):
        step = 0
        out.append((q, q, 0, rng.choice("ABCD")))
        for k in range(rng.randrange(1, 9)):
            step += rng.choice((0, 1, 1)) if step else 1
            out.append((q, 100 + 10 * q + k, step, rng.choice("ABCD")))
    return out


def test_last_good_against_a_walk(spark):
    ladders = random_ladders(random.Random(6), 80)
    got = dict(rows(events.last_good(spark.createDataFrame(ladders, LADDER))))
    for q, own in itertools.groupby(ladders, key=lambda x: x[0]):
        assert got[q] == walk_last_good([x[1:] for x in own], 0.5)


def test_steps_of_ladders_are_dealt_once(spark):
    """One exchange, by query, for sets, running unions and sizes; species beyond a word of 64 bits too."""
    rng = random.Random(2)
    ladder = [(q, i, rng.randrange(6), rng.choice([0, 1, 5, 63, 64, 65, 200])) for q in range(9) for i in range(25)]
    df = spark.createDataFrame(ladder, "query long, leaf long, step int, species int")
    steps = events.step_species(df)
    want = {}
    for q in range(9):
        seen = set()
        for s in range(6):
            here = {x[3] for x in ladder if x[0] == q and x[2] == s}
            if here and s:
                want[q, s] = (len(here), len(here & seen), len(seen))
            seen |= here
    assert {(r.query, r.step): (r.sister, r.overlap, r.browsed) for r in steps.collect()} == want
    assert steps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_long_lists_are_met_block_by_block(spark):
    groups = spark.range(1300).selectExpr("id % 2 AS query", "id AS m", "id % 5 AS k").unionByName(spark.range(50).selectExpr("7 AS query", "id AS m", "id AS k"))
    lists = {0: range(0, 1300, 2), 1: range(1, 1300, 2), 7: range(50)}
    got = events.member_pairs(groups, "m", "k", block=100).collect()
    assert sorted((r.query, r.a, r.b) for r in got) == sorted((q, a, b) for q, ms in lists.items() for a in ms for b in ms if str(a) < str(b))
    assert all((r.a_k, r.b_k) == ((r.a, r.b) if r.query == 7 else (r.a % 5, r.b % 5)) for r in got)


def test_no_key_has_more_than_a_pair_of_blocks(spark):
    """A list of 20,000: 210 keys of some 1,000 rows a side, and every pair has one of them."""
    left, right = events.member_blocks(spark.range(20000).selectExpr("1 AS query", "id AS m"), ["query"], "m", [])
    a, b = ({(r.i, r.j): r["count"] for r in df.groupBy("i", "j").count().collect()} for df in (left, right))
    assert len(a) == len(b) == 210 and max(*a.values(), *b.values()) < 1.2 * events.BLOCK
    within = sum(a[k] * (a[k] - 1) // 2 if k[0] == k[1] else a[k] * b[k] for k in a)
    assert within == 20000 * 19999 // 2
    # dealt to as many tasks, none has more than its share of block pairs
    tasks = left.repartition(64, "query", "i", "j").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 12 * events.BLOCK


def test_repeated_members_and_null_ones(spark):
    groups = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, None), (None, 5), (None, 6)], "query long, m long")
    for block in (1, 1000):
        assert rows(events.member_pairs(groups, "m", block=block)) == [(1, 5, 6), (1, 5, 6)]


def test_pair_counts(spark):
    lab = spark.createDataFrame([(1, 9, True), (1, 10, True), (1, 3, False), (2, 9, True), (2, 10, True), (3, 9, True), (3, 3, True), (4, 3, True), (4, 9, True)], "query long, leaf long, ortho boolean")
    none = spark.createDataFrame([(7, 3), (7, 4), (8, 3), (8, 4), (9, 4)], "query long, member long")
    got = rows(events.pair_counts(lab, none))
    assert got == [(3, 4, 2, 0), (3, 9, 2, 1), (10, 9, 2, 0)]  # 10 is before 9 as a string


def test_group_events(spark):
    ladder = spark.createDataFrame([(1, 1, 0, "A"), (1, 2, 1, "B"), (1, 3, 2, "A"), (1, 4, 3, "C"), (1, 5, 1, "D")], LADDER)
    og = spark.createDataFrame([("g", i) for i in (1, 2, 3, 4)], "og_name string, protein_id long")
    none = spark.createDataFrame([], "query long, member long")
    got = {(a, b): (o, p) for _, a, b, o, p in rows(events.group_pair_counts(ladder, none, og))}
    assert got == {(2, 1): (1, 0), (4, 1): (1, 0), (4, 2): (1, 0), (4, 3): (1, 0), (3, 1): (0, 1), (3, 2): (0, 1)}


def test_one_shared_species_with_enough_others_is_speciation(spark):
    og = spark.createDataFrame([("g", i) for i in range(1, 9)], "og_name string, protein_id long")
    none = spark.createDataFrame([], "query long, member long")
    make = lambda browsed, sister: spark.createDataFrame([(1, i + 1, min(i, 1), s) for i, s in enumerate(browsed)] + [(1, i + 5, 2, s) for i, s in enumerate(sister)], LADDER)
    ev = lambda b, s: {r.step: r.ortho for r in events.group_events(make(b, s), og).collect()}[2]
    assert ev("ABC", "ADE") is True
    assert ev("AB", "ADE") is False
    assert ev("ABC", "AD") is False
    assert none.count() == 0


def test_ratio_and_expansion(spark):
    counts = spark.createDataFrame([("g", 2, 1, 1, 1), ("g", 4, 3, 2, 1)], "og_name string, a long, b long, n_ortho long, n_para long")
    pairs = events.ortholog_pairs(counts, 0.5)
    assert [(r.a, r.b) for r in pairs.collect()] == [(4, 3)]
    cluster = spark.createDataFrame([(4, 4), (4, 5), (3, 3)], "rep_id long, member_id long")
    protein = spark.createDataFrame([(3, 0, "c"), (4, 1, "d"), (5, 1, "e")], "protein_id long, species_id int, name string")
    assert rows(events.expand_pairs(pairs, cluster, protein)) == [("d", "c"), ("e", "c")]
    same = protein.withColumn("species_id", F.lit(0))
    assert events.expand_pairs(pairs, cluster, same, not_same_sp=True).count() == 0


# ---- network


def test_weights_and_weak_edges(spark):
    counts = spark.createDataFrame([(1, 2, 10, 0), (2, 3, 100, 0), (3, 4, 2, 2), (4, 5, 3, 2)], "a long, b long, n_ortho long, n_para long")
    w = network.edge_weights(network.network_edges(counts))
    assert {(r.src, r.dst) for r in network.strong_edges(w, 0.1).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (5, 4)}
    assert {(r.src, r.dst) for r in network.strong_edges(w, 0.11).collect()} == {(2, 3), (3, 2), (4, 5), (5, 4)}
    h = dict(rows(network.weight_histogram(w)))
    assert len(h) == 21 and h[1.0] == 5 and h[0.1] == 1 and sum(h.values()) == 6


def test_clustering_against_brute_force(spark):
    rng = random.Random(8)
    und = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(300)}
    edges = [(a, b) for a, b in und] + [(b, a) for a, b in und]
    df = spark.createDataFrame(edges, "src long, dst long")
    for n_species in (3, 6):
        most, top = network.lcc_limits(n_species)
        got = {r.id: r.lcc for r in network.clustering(network.network_nodes(df), df, n_species).collect()}
        for v in {a for a, _ in edges}:
            near = sorted(b for a, b in edges if a == v)
            d = len(near)
            want = 0.0
            if d >= 4:
                use, nb = (near[:most], top) if d > most else (near, d * (d - 1))
                want = 2 * sum((x, y) in set(edges) for x, y in itertools.combinations(use, 2)) / nb
            assert abs(got[v] - want) < 1e-5
    assert network.lcc_limits(4) == (10, 90) and network.lcc_limits(6) == (12, 132)


def test_hits_on_edges(spark):
    hits = spark.createDataFrame([(1, 2, 5, 9), (1, 2, 3, 7), (1, 1, 1, 50), (1, 4, 2, 3), (2, 1, 1, 2)], "query long, target long, qstart int, qend int")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 0.5)], "src long, dst long, weight double")
    spans = network.hit_spans(hits)
    got = {(r.src, r.dst): (r.qstart, r.qend) for r in network.attach_hits(edges, spans).collect()}
    assert got == {(1, 2): (3, 9), (2, 1): (1, 2), (1, 3): (None, None)}
    assert rows(network.other_hits(edges, spans)) == [(1, 4)]


# ---- communities


def test_two_cliques_and_small_components(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a != b]
    edges = clique(range(0, 5)) + clique(range(10, 15)) + [(4, 10, 0.2), (10, 4, 0.2)] + clique([20, 21, 22]) + clique([30, 31, 32, 33])
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    ids = network.network_nodes(df)
    species = ids.withColumn("species", F.when(F.col("id") >= 30, 0).otherwise(F.col("id") % 5))
    nodes = network.clustering(ids, df, 5).join(species, "id")
    got = {r.id: (r.og, r.split) for r in communities.communities(nodes, df, communities.components_of(ids, df)).collect()}
    parts = {}
    for i, (og, _) in got.items():
        parts.setdefault(og, set()).add(i)
    assert sorted(map(sorted, parts.values())) == [list(range(5)), list(range(10, 15)), [20, 21, 22], [30, 31, 32, 33]]
    assert got[0][1] and got[12][1] and not got[20][1] and not got[30][1]


def random_network(rng, n, m):
    edges = {}
    while len(edges) < 2 * m:
        a, b = rng.sample(range(n), 2)
        for x, y in ((a, b), (b, a)):
            edges[x, y] = rng.choice([1.0, 0.5, 1 / 3, 2 / 3, 0.25, 0.1])
    near = {}
    for (x, y), w in edges.items():
        near.setdefault(x, []).append((y, w))
    return [(x, y, w) for (x, y), w in edges.items()], near


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_set_together_are_those_of_the_walk(spark, seed):
    rng = random.Random(seed)
    edges, near = random_network(rng, 40, 90)
    nodes = [(i, rng.choice([0.0, 0.0, 0.5, 0.3])) for i in range(42)]
    got = communities.propagate_together(spark.createDataFrame(nodes, "id long, lcc double"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert {r.id: r.label for r in got.collect()} == communities.propagate(nodes, near)


def test_labels_along_a_chain_and_around_a_hub(spark):
    chain = [(i, i + 1, 1.0 + i % 3) for i in range(12)]
    hub = [(100, i, 0.5) for i in range(101, 160)]
    edges = [e for a, b, w in chain + hub for e in ((a, b, w), (b, a, w))]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    nodes = [(i, 0.0) for i in near]
    got = communities.propagate_together(spark.createDataFrame(nodes, "id long, lcc double"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert {r.id: r.label for r in got.collect()} == communities.propagate(nodes, near)


def test_components_in_tasks_and_across_them_are_alike(spark):
    edges, _ = random_network(random.Random(7), 60, 70)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    ids = network.network_nodes(df)
    nodes = network.clustering(ids, df, 5).withColumn("species", F.col("id") % 5)
    members = communities.components_of(ids, df)
    assert rows(communities.communities(nodes, df, members)) == rows(communities.communities(nodes, df, members, in_task=0))


def test_ties_take_the_first_label_by_weight_then_id():
    near = {1: [(2, 0.5), (3, 1.0)], 2: [(1, 1.0)], 3: [(1, 1.0)]}
    assert communities.propagate([(1, 0.0), (2, 0.0), (3, 0.0)], near) == {1: 3, 2: 3, 3: 3}


def test_exact_medians(spark):
    import statistics

    rng = random.Random(1)
    data = [(k, rng.choice([None, 1, 5, -3, 2000, rng.randrange(-5000, 5000)]), rng.randrange(3)) for k in range(30) for _ in range(rng.randrange(1, 30))] + [(99, None, 4)]
    got = {r.k: (r.a, r.b) for r in exact_medians(spark.createDataFrame(data, "k int, a int, b int"), ["k"], ["a", "b"], width=16).collect()}
    for k in {r[0] for r in data}:
        a, b = [r[1] for r in data if r[0] == k and r[1] is not None], [r[2] for r in data if r[0] == k]
        assert got[k] == (statistics.median(a) if a else None, statistics.median(b))


def test_the_median_of_a_million_values_of_one_key(spark):
    rows_ = spark.range(1_000_000).selectExpr("1 AS k", "(id * 7919) % 1000003 AS v")
    assert exact_medians(rows_, ["k"], ["v"]).first().v == rows_.selectExpr("percentile(v, 0.5) AS p").first().p


@pytest.mark.parametrize("start,fused", [(101, True), (100, True), (99, False)])
def test_chimera_by_overlap(spark, start, fused):
    found = [(0, 0, 1, True)] + [(i, 0, 1, True) for i in (1, 2, 3)] + [(i, 0, 2, True) for i in (4, 5, 6)]
    f = spark.createDataFrame(found, "id long, component long, og long, split boolean")
    edges = [(0, i, 1, 100) for i in (1, 2, 3)] + [(0, i, start, 200) for i in (4, 5, 6)]
    e = spark.createDataFrame(edges, "src long, dst long, qstart int, qend int")
    sp = spark.createDataFrame([(i, i % 3) for i in range(7)], "id long, species long")
    assert rows(chimera.chimeras(f, e, sp)) == ([(0, 2)] if fused else [])
    assert rows(chimera.chimeras(f, e, sp, min_species=4)) == []
    assert rows(chimera.chimeras(f, e.where("dst <> 5"), sp)) == []  # too few species


def test_supported_members(spark):
    m = spark.createDataFrame([(i, 1) for i in range(4)] + [(i, 2) for i in (10, 11, 12)], "id long, og long")
    edges = spark.createDataFrame([(0, 1, 1, 9), (0, 2, 1, 9), (1, 0, 1, 9), (1, 9, 1, 9), (2, 0, None, None), (2, 1, None, None)], "src long, dst long, qstart int, qend int")
    others = spark.createDataFrame([(1, 3), (3, 0)], "query long, target long")
    assert rows(chimera.supported(m, edges, others, 2)) == [(0, 1), (1, 1), (10, 2), (11, 2), (12, 2)]


# ---- reports


def test_reports(spark):
    species = spark.createDataFrame([(0, "a.fa"), (1, "b.fa")], "species_id int, file_name string")
    protein = spark.createDataFrame([(1, 0, "p1"), (2, 1, "p2"), (3, 0, "p3"), (4, 1, "p4"), (5, 0, "p5"), (6, 0, "p6")], "protein_id long, species_id int, name string")
    of = protein.select(F.col("protein_id").alias("id"), F.col("species_id").alias("species"))
    cluster = spark.createDataFrame([(1, 1), (1, 6), (2, 2), (3, 3), (4, 4), (5, 5)], "rep_id long, member_id long")
    members = spark.createDataFrame([(3, 30), (4, 30), (2, 10), (1, 10), (3, 10), (5, 50)], "id long, og long")
    og = reports.name_groups(members, of)
    assert rows(og) == [("OG_1", 1), ("OG_1", 2), ("OG_1", 3), ("OG_2", 3), ("OG_2", 4)]
    full = reports.expanded(og, cluster, protein)
    assert dict(rows(reports.groups_list(full))) == {"OG_1": "p1 p2 p3 p6", "OG_2": "p3 p4"}
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src long, dst long")
    stats = reports.group_statistics(og, full, edges, of)
    assert rows(stats) == [("OG_1", 2, 3, 4, 0.3333), ("OG_2", 2, 2, 2, 0.5)]
    assert rows(reports.group_table(full, species)) == [("OG_1", 3, 1), ("OG_2", 1, 1)]
    assert rows(reports.group_table(full, species, names=True)) == [("OG_1", "p1 p3 p6", "p2"), ("OG_2", "p3", "p4")]
    fused = spark.createDataFrame([(3, 30), (5, 10)], "id long, og long")
    assert rows(reports.chimera_report(fused, og, protein, species)) == [("a.fa", "p3", 2, "OG_1 OG_2"), ("a.fa", "p5", 0, "")]
    assert rows(reports.unclassified(full, protein)) == [("p5",)]
    reduced = protein.where("protein_id <> 6")
    assert rows(reports.species_statistics(full, reduced, species)) == [("a.fa", 133.3, 4), ("b.fa", 100.0, 2)]
    assert rows(reports.groups_by_species_count(stats, 2)) == [(0, 0), (1, 0), (2, 2)]
    assert rows(reports.cluster_log(cluster.join(protein.withColumnRenamed("protein_id", "member_id"), "member_id").withColumnRenamed("species_id", "grp"), species)) == [(0, "a.fa", 4, 3), (1, "b.fa", 2, 2)]


def test_with_index_counts_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = with_index(df.repartition(7), [F.col("x")], "n").collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000


def test_group_tables_have_a_column_for_every_species(spark):
    n = 10_002
    species = spark.range(n).select(F.col("id").alias("species_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("file_name"))
    full = spark.createDataFrame([("OG_1", 0, "a"), ("OG_1", n - 1, "b")], "og_name string, species_id long, name string")
    table = reports.group_table(full, species, names=True)
    assert len(table.columns) == n + 1
    row = table.first()
    assert (row["s0"], row["s5000"], row[f"s{n - 1}"]) == ("a", "", "b")
