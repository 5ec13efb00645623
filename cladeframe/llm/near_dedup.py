"""Near-duplicate documents by the Jaccard similarity of their word shingles, exact.

The grid over SimHash fingerprints (``simhash.near_links``) comes first: sets
whose fingerprints are within ``DISTANCE`` bits are candidates, and the exact
similarity decides.  Two sets at similarity 0.8 differ in some ten of 64 bits,
more than a grid can carry, so what it doesn't reach is found on the shingles.

1. Frequencies.  Rows are dealt once to chunks by a hash.  A chunk reduces its
   shingles to one entry each, which travel packed to buckets by hash range; a
   bucket tells a chunk those that occur elsewhere or more than once, and how
   often.  The entries are the first 48 bits of the hashes, so of 10**13 shingles
   one in thirty is taken for more frequent than it is; what occurs once by
   that count does occur once.  Any order by a function of the shingle is exact;
   frequencies decide the cost only.  The names of a chunk's sets go with their least
   shingles, and a bucket tells a chunk those that a chunk before it has too.
2. Postings.  Of a set's shingles in order of frequency, then of hash, the first
   n - ceil(t n) + 1 are its prefix.  Two sets of similarity t or more share one
   in both prefixes.  Those that occur once are not posted, so a document
   most of whose shingles are its own posts nothing at all.  Rows with equal sets
   are one node, which the first chunk that has it posts, once: no table of shingles
   is sent to find copies.
3. SimHash.  Each posting node has a fingerprint of its shingles.  Nodes of one
   fingerprint meet the least of them, and those meet along the grid's links;
   all are verified.
4. Links.  In each list a node meets the one that has the list's shingle first in
   its order, which has the fewest shingles of its own and so of variants of one
   text is near to most, for the ``LEADERS`` shortest lists it is in, unless they are joined already.  What the links found so far join needs no further
   test.  In lists that still hold several components, nodes outside the largest
   meet one member of it that is drawn anew in each of ``ROUNDS`` rounds.  In what
   is left, every pair across components whose sizes, places in the order and
   sketches can fit is a candidate, and is verified.  The places are judged as
   those of the first shingle that the two share, so a pair fits there or
   nowhere; where one of the ``BEFORE`` postings before is shared too, the pair
   has met already and makes no row again.  That loses no link that would join
   components.  A sketch has a bit for each of ``BITS`` slots: whether an odd number of the set's
   shingles fall in it.  Two sketches differ in no more bits than the sets in
   shingles, so like a grid's bound it rules pairs out before the exact test.

A shingle, leader or group of copies in a third of all rows is an entry a chunk,
a broadcast or skew-split join key and a star.

Rows: case is folded for ASCII only; a text of fewer than ``width`` words is one
shingle; null texts and those without words are equal to each other; a null id
counts as the largest; of repeated rows (ties) one stays; a very long text is one
set; extra columns are passed on; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cladeframe.functions.storage import materialize, shuffle_partitions
from cladeframe.llm import simhash
from cladeframe.llm.rows import keep_rows, row_names
from cladeframe.llm.substring_dedup import MOST_TASKS, RANGE, _pack, _unpack, chunk_count
from cladeframe.llm.words import WordHashes, as_bytes, rolling
from cladeframe.operators.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
LEADERS, ROUNDS = 2, 2
#: Postings of a node before the one in a list that are told there.
BEFORE = 4
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = 2
TINY = 1e-9
#: Slots of a sketch, and its columns of 64 each.
BITS = 2048
SKETCH = [f"s{i}" for i in range(BITS // 64)]
#: Columns of a sketch folded to a quarter, which postings carry.
FOLDED = [f"f{i}" for i in range(BITS // 256)]
#: Bits of a shingle's hash that frequencies leave out.
DROPPED = np.uint64(16)
#: Rows of a batch of nodes.
BATCH = 256
#: Nodes that are sent to all tasks, some tens of megabytes; beyond, they are joined by an exchange.
BROADCAST = 1_000_000
NODES = "doc_id long, row long, row2 long, node long, n int, keys binary, places binary, grams binary, fp long, " + ", ".join(f"{c} long" for c in SKETCH)


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = text.lower().split() if text else []
    return np.unique(rolling(hashes.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def set_name(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of the slots, 64 in a number."""
    slots = ((grams >> np.uint64(24)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of the shingles: each bit as in most of their hashes."""
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(grams), bitorder="little").view(np.int64)[0])


def posted(n: int, t: float) -> int:
    return n - ceil(t * n - TINY) + 1 if n else 0


def rarity(counts: np.ndarray) -> np.ndarray:
    """Frequencies as a byte, eight steps a doubling."""
    return np.minimum(255, np.floor(8 * np.log2(counts.astype(np.float64)))).astype(np.uint8)


def _count_chunk(width: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        hashes = WordHashes()
        sets = {s.tobytes(): s for s in (shingle_set(x, width, hashes) for x in as_bytes(t.column("text")))}
        h, n = np.unique(np.concatenate([*sets.values(), np.empty(0, np.uint64)]) >> DROPPED, return_counts=True)
        named = [(x[0] >> DROPPED, set_name(x)) for x in sets.values() if len(x)]
        del sets
        least, names = np.array([x for x, _ in named], np.uint64), np.array([x for _, x in named], np.int64)
        chunk = t.column("chunk")[0].as_py()
        rows: dict[str, list] = {"bucket": [], "chunk": [], "n": [], "hashes": [], "counts": [], "names": []}
        edges = np.array([-(-(k << 48) // buckets) for k in range(1, buckets)], dtype=np.uint64)
        cuts = [0, *np.searchsorted(h, edges), len(h)]
        of = np.searchsorted(edges, least, side="right")  # a set's least shingle is in h, so its bucket has a row
        by = np.argsort(of, kind="stable")
        own = np.split(names[by], np.searchsorted(of[by], np.arange(1, buckets)))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                for column, v in zip(rows.values(), (k, chunk, int(b - a), _pack(h[a:b]), np.minimum(n[a:b], 255).astype(np.uint8).tobytes(), own[k].tobytes())):
                    column.append(v)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return run


def _tell_bucket(t: pa.Table) -> pa.Table:
    """For each chunk, those of its shingles that occur more than once, and how often; and its sets that a chunk before it has too."""
    sizes, chunks = t.column("n").to_pylist(), t.column("chunk").to_pylist()
    names = [np.frombuffer(x.as_buffer(), np.int64) for x in t.column("names")]
    of = np.repeat(np.array(chunks), [len(x) for x in names])
    names = np.concatenate(names)
    order = np.lexsort((of, names))
    later = order[1:][names[order[1:]] == names[order[:-1]]]
    of, names = of[later], names[later]
    hashes = [_unpack(x.as_buffer(), n) for x, n in zip(t.column("hashes"), sizes)]
    counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("counts")]
    low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes)
    parts = -(-sum(sizes) // RANGE)
    edges = np.array([low + (high - low + 1) * r // parts for r in range(1, parts)], dtype=np.uint64)
    cuts = [np.r_[0, np.searchsorted(h, edges), len(h)] for h in hashes]
    told: list[list] = [[] for _ in hashes]
    for r in range(parts):
        at = [(i, int(c[r]), int(c[r + 1])) for i, c in enumerate(cuts) if c[r] < c[r + 1]]
        if not at:
            continue
        h = np.concatenate([hashes[i][a:b] for i, a, b in at])
        n = np.concatenate([counts[i][a:b] for i, a, b in at]).astype(np.int64)
        row = np.repeat(np.array([i for i, _, _ in at], np.int32), [b - a for _, a, b in at])
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
        total = np.repeat(np.add.reduceat(n[order], begin), np.diff(np.r_[begin, len(h)]))
        some = order[total > 1]
        h, row, total = h[some], row[some], total[total > 1]
        by = np.argsort(row, kind="stable")  # of a row they stay in order of the hash
        ends = np.searchsorted(row[by], np.arange(len(hashes) + 1))
        for i in np.unique(row):
            own = by[ends[i] : ends[i + 1]]
            told[i].append((h[own], rarity(total[own])))
    rows: dict[str, list] = {"chunk": [], "n": [], "hashes": [], "rarities": [], "copies": []}
    for c, parts_of in zip(chunks, told):
        if parts_of:  # as it has if it has copies, whose least shingles occur in two chunks
            h, f = (np.concatenate(x) for x in zip(*parts_of))
            for column, v in zip(rows.values(), (c, len(h), _pack(h), f.tobytes(), names[of == c].tobytes())):
                column.append(v)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def _post_chunk(width: int, t: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = [_unpack(x.as_buffer(), n) for x, n in zip(told.column("hashes"), told.column("n").to_pylist())]
        often = [np.frombuffer(x.as_buffer(), np.uint8) for x in told.column("rarities")]
        known, often = (np.concatenate([*x, np.empty(0, k)]) for x, k in ((known, np.uint64), (often, np.uint8)))
        order = np.argsort(known)
        known, often = known[order], often[order]
        hashes, seen = WordHashes(), set(np.frombuffer(b"".join(told.column("copies").to_pylist()), np.int64).tolist())
        out: list[list] = [[] for _ in range(6)]
        none, bits = np.zeros(len(SKETCH), np.int64), []
        for text in as_bytes(docs.column("text")):
            s = shingle_set(text, width, hashes)
            node, keys, places, grams = set_name(s), None, None, None
            if len(s) and len(known) and node not in seen:  # a set is posted once, by the first chunk that has it
                seen.add(node)
                short = s >> DROPPED
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                found = known[at] == short
                f = np.where(found, often[at], 0)
                first = np.lexsort((s, f))[: posted(len(s), t)]
                place = np.flatnonzero(f[first]).astype(np.int32)
                if len(place):
                    keys, places, grams = s[first[place]].tobytes(), place.tobytes(), s.tobytes()
            for o, v in zip(out, (node, len(s), keys, places, grams, None if keys is None else fingerprint(s))):
                o.append(v)
            bits.append(none if keys is None else sketch(s))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        posts = pa.array([k is not None for k in out[2]], pa.bool_())
        made = [docs.column(c) for c in ("doc_id", "row", "row2")] + [pa.array(o, k) for o, k in zip(out, kinds)]
        made += [pc.if_else(posts, pa.array(np.ascontiguousarray(c)), None) for c in np.array(bits).T]
        # sent in small batches, as the executor holds their buffers beside its heap
        table = pa.table(made, names=["doc_id", "row", "row2", "node", "n", "keys", "places", "grams", "fp", *SKETCH])
        return pa.Table.from_batches(table.to_batches(BATCH), table.schema)

    return run


def _nodes(docs: DataFrame, width: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, row2, node, n, keys, places, grams, fp, sketch) of each row; from keys on null unless it posts, as one row of a node at most does."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row_names(id_col, text_col))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = chunk_count(total, shuffle_partitions(spark))
    tasks = min(n, MOST_TASKS)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.spark_partition_id()), F.lit(n)).cast("int")).repartition(tasks, "chunk")
    parts = dealt.groupBy("chunk").applyInArrow(_count_chunk(width, n), "bucket int, chunk int, n int, hashes binary, counts binary, names binary")
    told = parts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_tell_bucket, "chunk int, n int, hashes binary, rarities binary, copies binary")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_post_chunk(width, t), NODES)


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, node, n, place) of each posted shingle."""

    def run(batches):
        for b in batches:
            sizes = [len(x) // 8 for x in b.column(2).to_pylist()]
            key = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            place = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32)
            own = [pa.array(np.repeat(np.asarray(b.column(i)), sizes)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *own, pa.array(place)], names=["key", "node", "n", "place"])

    return nodes.select("node", "n", "keys", "places").mapInArrow(run, "key long, node long, n int, place int")


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (src, dst) whose sets have similarity ``t`` or more; sketches rule out most others first."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) * (1 + t) >= t * (len(x) + len(y)) - TINY)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    marks = sets.select("node", "n", *SKETCH)
    a, b = marks.alias("a"), marks.alias("b")
    near = pairs.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).where(_sketches_fit(t))
    near = materialize(near.select("src", "dst"), "near-pairs")
    # Only the sets of those pairs move.
    ends = near.select(F.col("src").alias("node")).unionByName(near.select(F.col("dst").alias("node"))).distinct()
    ends = materialize(ends, "near-ends")
    if ends.count() <= BROADCAST:  # the sets are read where they are
        ends = F.broadcast(ends)
    own = materialize(sets.select("node", "grams").join(ends, "node", "left_semi"), "near-grams")
    a, b = (own.select(F.col("node").alias(end), F.col("grams").alias(f"{end}_grams")) for end in ("src", "dst"))
    both = near.join(a, "src").join(b, "dst").select("src", "dst", "src_grams", "dst_grams")
    return both.mapInArrow(run, "src long, dst long")


def _fits(t: float) -> str:
    """Whether two sets whose first shared shingle has these places in their orders can be similar enough."""
    need = f"ceil({t / (1 + t)} * (a.n + b.n) - {TINY})"
    return f"least(a.n, b.n) >= {t} * greatest(a.n, b.n) - {TINY} and least(a.n - a.place, b.n - b.place) >= {need}"


def _folded() -> list[Column]:
    """A sketch of a quarter of the slots, each the parity of four."""
    n = len(FOLDED)
    return [F.expr(" ^ ".join(SKETCH[i::n])).alias(c) for i, c in enumerate(FOLDED)]


def _sketches_fit(t: float, columns: list[str] = SKETCH) -> Column:
    """Whether the sketches of a and b differ in no more bits than near sets may in shingles."""
    apart = F.lit(0)
    for c in columns:
        apart = apart + F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    return apart <= (1 - t) / (1 + t) * (F.col("a.n") + F.col("b.n")) + TINY


def _ends() -> list:
    return [F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")]


def _placed(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Lists of several components, with the component of each node and the largest of the list."""
    placed = lists.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("count"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts"))
    return materialize(placed.join(main.where("parts > 1").select("key", "main"), "key"), "near-mixed")


def _shortest(pairs: DataFrame, leaders: int) -> DataFrame:
    """(src, dst) of (src, dst, size, key): for each dst those of its shortest lists."""
    turn = F.row_number().over(Window.partitionBy("dst").orderBy("size", "key"))
    return pairs.withColumn("turn", turn).where(F.col("turn") <= leaders).select("src", "dst").distinct()


def _met(mixed: DataFrame, sketches: DataFrame, t: float) -> DataFrame:
    """(src, dst) across the components of each list, those that can be near; few of them more than once."""
    before = Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1)
    told = mixed.withColumn("before", F.collect_list("key").over(before)).join(sketches, "node").repartition("key")  # sent once for both sides
    a, b = told.where("component <> main").alias("a"), told.alias("b")
    pairs = a.join(b, F.col("a.key") == F.col("b.key")).where("a.component <> b.component and (b.component = b.main or a.node < b.node)")
    pairs = pairs.where(_fits(t)).where(_sketches_fit(t, FOLDED))
    # A list before that holds both has their components too, so they meet there if they can be near.
    return pairs.where(~F.arrays_overlap("a.before", "b.before")).select(*_ends())


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """(src, dst): nodes of one fingerprint and the least of them, and those least ones along the links of the grid."""
    named = materialize(sets.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    same = sets.join(named, "fp").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    end = lambda c: named.select(F.col("fp").alias(f"{c}_fp"), F.col("least").alias(c))
    links = simhash.near_links(named.select("fp"), DISTANCE).toDF("src_fp", "dst_fp")
    return same.unionByName(links.join(end("src"), "src_fp").join(end("dst"), "dst_fp").select("src", "dst"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes that ``parts`` don't join."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    placed = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return placed.where("src_part IS NULL OR dst_part IS NULL OR src_part <> dst_part").select("src", "dst")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (src, dst) between nodes; a node that is not in ``parts`` is its own."""
    old = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    named = links.join(old("src"), "src", "left").join(old("dst"), "dst", "left")
    ends = named.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    found = connected_components(ends).withColumnsRenamed({"node": "part", "component": "whole"})
    moved = parts.join(found, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = found.join(parts, F.col("node") == F.col("part"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return materialize(moved.unionByName(new), "near-parts")


def near_nodes(docs: DataFrame, width: int = WIDTH, t: float = SIMILARITY, leaders: int = LEADERS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, row2, node) of each row, and (node, component) of the nodes that have a near one."""
    nodes = materialize(_nodes(docs, width, t, id_col, text_col), "near-nodes")
    sets = nodes.where("keys is not null").select("node", "n", "keys", "places", "grams", "fp", *SKETCH)
    posts = _postings(sets)
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("place", "node")).alias("first")).where("size > 1")
    lists = materialize(posts.join(sizes.select("key", "size", F.col("first.node").alias("lead")), "key"), "near-lists")

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(_verified(materialize(pairs, "near-met"), sets, t), "near-links")

    met = lists.where("node <> lead").select(F.col("lead").alias("src"), F.col("node").alias("dst"), "size", "key")
    parts = materialize(connected_components(verified(_simhash_pairs(sets.select("node", "fp")))), "near-parts")
    parts = _joined(parts, verified(_apart(_shortest(met, leaders), parts)))
    mixed = _placed(lists, parts)
    for r in range(rounds):
        drawn = mixed.where("component = main").groupBy("key").agg(F.min_by(F.struct("node", "n", "place"), F.xxhash64("node", "key", F.lit(r))).alias("drawn"))
        a, b = mixed.where("component <> main").alias("a"), drawn.select("key", "drawn.*").alias("b")
        pairs = a.join(b, F.col("a.key") == F.col("b.key")).where(_fits(t))
        links = verified(_shortest(pairs.select(F.col("b.node").alias("src"), F.col("a.node").alias("dst"), "a.size", "a.key"), leaders))
        if links.isEmpty():
            break
        parts = _joined(parts, links)
        mixed = _placed(mixed.drop("component", "main"), parts)
    drawn = materialize(sets.select("node", *_folded()).join(mixed.select("node").distinct(), "node", "left_semi"), "near-sketches")
    across = _met(mixed, drawn, t).distinct()
    return nodes.select("doc_id", "row", "row2", "node"), _joined(parts, verified(across))


def keep_one(docs: DataFrame, width: int = WIDTH, t: float = SIMILARITY, leaders: int = LEADERS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id of each component of near duplicates, with all its columns; one of rows that are repeated."""
    rows, found = near_nodes(docs, width, t, leaders, rounds, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "row2")).alias("least")
    own = rows.groupBy("node").agg(least)
    stay = own.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    gone = rows.select("row", "row2").distinct().join(stay.select("least.row", "least.row2"), ["row", "row2"], "left_anti")
    return keep_rows(docs, gone, id_col, text_col)
