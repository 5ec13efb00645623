import hashlib
import random
import zlib

from fixtures import words
from pyspark.sql import functions as F

from cladeframe.llm.prefix_trie import dense_names, numbered_turns, prefix_trie, share_heads

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(full[c]) + 1):
            nodes.setdefault(tuple(full[c][:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        leaves = sum(x not in children for x in below)
        saved = sum((len(nodes[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    return sorted(map(tuple, prefix_trie(*share_heads(numbered_turns(df))).collect()), key=str)


def conversations(seed, n=70):
    rng = random.Random(seed)
    say = [("user", "hi there"), ("assistant", "hello"), ("user", None), (None, "a b c"), (None, None), ("user", "")]
    rows = []
    for c in range(n):
        turns = [rng.choice(say) for _ in range(rng.choice([1, 1, 2, 3, 4, 7, 9, 17]))]
        if c % 3 == 0 and rows:  # a copy
            turns = [(r[2], r[3]) for r in rows if r[0] == rng.choice([0, 20, c - 1])] or turns
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def test_against_brute_force(spark):
    rows = conversations(5)
    rows += [(100, None, "user", "first"), (100, 3, "user", "tie"), (100, 3, "user", "tie"), (100, 3, "assistant", "tie"), (100, 2, None, "x")]
    rows += [(None, 1, "user", "of none"), (121, 5, "user", "one turn, no base"), (1 << 40, 0, "user", "hi there")]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS name", "2 AS conv").repartition(3)
    assert trie(df) == brute(rows)


def test_a_long_conversation_and_its_copy(spark):
    rows = [(c, i, "user", f"turn {i % 7}") for c in (0, 20) for i in range(700)] + [(1, 0, "user", "turn 0")]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == sorted(_chain(rows), key=str)


def _chain(rows):
    """As :func:`brute`, for long conversations: the nodes are those of one path and those of conversation 1."""
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role, text))
    full = {c: own[c - c % 20][: zlib.crc32(str(c).encode()) % 4] + own[c][zlib.crc32(str(c).encode()) % 4 :] for c in own}
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault((d, c if c == 1 and turns[:d] != full[0][:d] else 0), []).append(c)
    parent = lambda d, w: (d - 1, w if (d - 1, w) in nodes else 0)
    n_children, sums = {}, {}
    for k in nodes:
        if k[0]:
            n_children[parent(*k)] = n_children.get(parent(*k), 0) + 1
    for k in sorted(nodes, reverse=True):
        leaf, saved = sums.get(k, (0, 0))
        turn = full[min(nodes[k])][k[0] - 1][1] if k[0] else ""
        mine = leaf + (k not in n_children), saved + (len(nodes[k]) - 1) * len(turn.split())
        sums[k] = mine
        if k[0]:
            p = parent(*k)
            a, b = sums.get(p, (0, 0))
            sums[p] = a + mine[0], b + mine[1]
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == k[0])
        yield min(m), k[0], min(nodes[parent(*k)]) if k[0] else None, len(m), n_children.get(k, 0), *sums[k], hashlib.sha256(ends.encode()).hexdigest()


def test_many_ends_in_one_node(spark):
    """Lists of ids over many pieces, negative ones first."""
    rows = spark.range(-300, 9000, 20).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("same words").alias("text"))
    got = {r.depth: r for r in prefix_trie(numbered_turns(rows), rows.select(F.col("conv_id").alias("conv"))).collect()}
    ids = ",".join(str(i) for i in range(-300, 9000, 20))
    assert got[1].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[1].n_convs == 465 and got[0].saved_tokens == 2 * 464


def test_dense_names(spark):
    df = spark.range(1000).selectExpr("id % 37 AS x", "id % 3 AS y").repartition(5)
    got = dense_names(df, ["x", "y"], "n").collect()
    assert len({(r.x, r.y) for r in got}) == len(got) == 111 and sorted(r.n for r in got) == list(range(111))


def test_turns_without_a_number_and_an_empty_table(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    rows = [(7, None, "user", "same")] * 50
    got = numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.pos for r in got) == list(range(1, 51))
