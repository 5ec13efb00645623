"""Mixing sources to target weights, in blocks of a fixed number of words.

1. Every source gets a target: its weight's share of ``share`` times all words,
   at most ``cap`` times its own size; what that cuts is shared anew by weight.
2. The words of a source are packed into blocks of ``block_words``.  Offsets are
   prefix sums in two levels (within buckets of rows, then over buckets), so a
   hot source isn't summed in one task.
3. A source's slots are its whole passes and the part of a last pass that meets
   its target to the word; the last slot is trimmed.  Output shards of
   ``shard_slots`` slots draw their source counts multinomially, given those
   totals (unconditioned draws would miss small targets and break the cap).  The
   draws split shard ranges in halves, seeded by range, so any part of the tree
   can be drawn anywhere and gives the same counts and offsets: a task walks
   from the root to its own ranges, and the driver holds two numbers a source.
4. Slot k of a source maps to a block through the source's pseudorandom
   permutation of its pass (a keyed Feistel network, walked into the range), so a
   block is used once a pass, and slots meet blocks in an equi-join on
   (source, block), where no key has more rows than a block has words.

Rows: a null text has no words, gets no block and takes 0; null sources are one
source, last in order; rows with equal ids are separate; repeated rows are
counted before they are laid out, and each is taken from by its own place; a very long
text is as many pieces as it has blocks; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize, shuffle_partitions, spread
from cladeframe.llm.words import word_count

WEIGHTS = (3, 1, 2)
#: More sources than this are refused: their names and sizes pass through the driver, two numbers each to the tasks.
MOST_SOURCES = 1_000_000
BLOCK_WORDS, SHARD_SLOTS, SEED = 256, 512, 20240229


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Target of each source, in order: capped shares, the excess shared anew by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return out


def permute(index: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to ``index``: Feistel with cycle walking."""
    if n <= 1:
        return index.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = np.random.SeedSequence(key).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in rounds:
            f = (right + r) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each kind are among ``take`` drawn without replacement, at any size.

    Each item is first drawn on its own with the chance take / all.  Given how many
    that gives, they are a uniform subset; a uniform subset of the surplus is put
    back, or one of what is missing is drawn from the rest.  Surplus and
    missing are about the square root of ``take``, so this ends after some rounds.
    """
    total = int(counts.sum())
    if take <= 0 or total == 0:
        return np.zeros_like(counts)
    if take >= total:
        return counts.copy()
    if take <= 8:
        out, left = np.zeros_like(counts), counts.copy()
        for _ in range(take):
            ends = np.cumsum(left)
            k = int(np.searchsorted(ends, rng.integers(int(ends[-1])), side="right"))
            out[k] += 1
            left[k] -= 1
        return out
    out = rng.binomial(counts, take / total)
    more = take - int(out.sum())
    return out + _draw(rng, counts - out, more) if more >= 0 else out - _draw(rng, out, -more)


def _split(seed: tuple[int, ...], counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each source fall in the first ``take`` slots: multinomial given the totals."""
    return _draw(np.random.default_rng(seed), counts, take)


def _halve(seed: int, node: tuple, slots: int) -> tuple[tuple, tuple]:
    a, b, counts, first = node
    m = (a + b) // 2
    left = _split((seed, a, b), counts, (m - a) * slots)
    return (a, m, left, first), (m, b, counts - left, first + left)


def _ranges(shards: int, most: int = 4096, least: int = 16) -> list[tuple[int, int]]:
    """Ranges of the halving tree, for tasks."""
    out = [(0, shards)] if shards else []
    while len(out) < most and any(b - a > least for a, b in out):
        out = [x for a, b in out for x in (((a, (a + b) // 2), ((a + b) // 2, b)) if b - a > least else ((a, b),))]
    return out


def draw_shards(spark: SparkSession, slots: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(shard, source_no, first, n): the slots that each shard takes of each source."""
    all_slots = np.array(slots, np.int64)
    shards = -(-int(all_slots.sum()) // shard_slots)
    ranges = _ranges(shards)
    known = spark.sparkContext.broadcast(all_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        # Ranges come in order, so the path to the next shares its beginning with the path to this one.
        path = [(0, shards, counts, np.zeros_like(counts))]
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: r["a"]):
                while not path[-1][0] <= r["a"] < path[-1][1]:
                    path.pop()
                while (path[-1][0], path[-1][1]) != (r["a"], r["b"]):
                    left, right = _halve(seed, path[-1], shard_slots)
                    path.append(left if r["a"] < left[1] else right)
                todo, out = [path[-1]], []
                while todo:
                    node = todo.pop()
                    if node[1] - node[0] > 1:
                        todo += _halve(seed, node, shard_slots)
                        continue
                    some = np.flatnonzero(node[2])
                    out.append((np.full(len(some), node[0]), some, node[3][some], node[2][some]))
                    if len(out) == 256 or not todo:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["shard", "source_no", "first", "n"])
                        out = []

    tree = spark.createDataFrame(ranges, "a long, b long").repartition(max(1, min(len(ranges), shuffle_partitions(spark))))
    return tree.mapInArrow(run, "shard long, source_no long, first long, n long")


def place_slots(shards: DataFrame, sizes: list[int], wanted: list[int], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source_no, block, words): the block of each slot and how many of its words it takes."""
    plan = shards.sparkSession.sparkContext.broadcast((sizes, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, want = plan.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            shard, source, first, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            before: dict[int, int] = {}
            for sh, s, k0, m in zip(shard.tolist(), source.tolist(), first.tolist(), n.tolist()):
                per = -(-size[s] // block_words)
                full = size[s] // block_words  # a short last block ends each pass
                k = np.arange(k0, k0 + m)
                turn, at = k // per, k % per
                block = at.copy()
                for p in np.unique(turn):
                    own = (turn == p) & (at < full)
                    block[own] = permute(at[own], full, [seed, s, int(p)])
                words = np.where(block < full, block_words, size[s] - full * block_words)
                upto = turn * size[s] + np.minimum(at * block_words, size[s])  # words in earlier slots
                words = np.minimum(words, want[s] - upto)
                slot = np.arange(m) + before.get(sh, 0)
                before[sh] = before.get(sh, 0) + m
                for o, x in zip(out, (np.full(m, sh), slot, np.full(m, s), block, words)):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["shard", "slot", "source_no", "block", "words"])

    return shards.mapInArrow(run, "shard long, slot long, source_no long, block long, words long")


class Mixture:
    """A planned mixture of ``docs``; its parts are DataFrames.

    sources: source, source_no, source_size, target
    pieces:  source_no, block, place, at, doc_id, row, start, n   (words start..start+n of a row, at ``place`` in a block)
    slots:   shard, slot, source_no, block, words
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        sized = spread(docs).select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col).cast("string")).alias("size"),
            F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("row"),
        )
        self.sized = sized = materialize(sized, "mix-sizes")
        per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        found = per.limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        goal = targets(sizes, weights, share, cap)
        rows = [(r["source"], i, r["size"], float(t)) for i, (r, t) in enumerate(zip(found, goal))]
        sources = spark.createDataFrame(rows, "source string, source_no long, source_size long, target double")
        self.sources = F.broadcast(sources) if len(rows) <= 10_000 else sources
        wanted = [min(round(t), math.floor(cap * s)) for t, s in zip(goal, sizes)]
        slots = [0 if not s else (w // s) * -(-s // block_words) + -(-(w % s) // block_words) for w, s in zip(wanted, sizes)]
        self.block_words = block_words
        self.pieces = self._pack(sum(r["n"] for r in found))
        # Written, so that the planner knows its size: it grows with the words, and must not be broadcast unless small.
        self.slots = materialize(place_slots(draw_shards(spark, slots, shard_slots, seed), sizes, wanted, block_words, shard_slots, seed), "mix-slots")

    def _named(self) -> DataFrame:
        return self.sources.withColumnRenamed("source", "named")

    def _pack(self, n_rows: int) -> DataFrame:
        """Lay each source's rows end to end and cut them at block ends."""
        spark = self.sized.sparkSession
        buckets = max(shuffle_partitions(spark), -(-n_rows // 20_000))
        counted = self.sized.where("size > 0").groupBy("source", "doc_id", "row", "size").agg(F.count("*").alias("copies"))
        keyed = counted.join(self._named(), F.col("source").eqNullSafe(F.col("named"))).select(
            "doc_id", "row", "size", "copies", "source_no", F.pmod(F.xxhash64("row", "doc_id"), F.lit(buckets)).alias("bucket")
        )
        words = F.col("size") * F.col("copies")
        totals = keyed.groupBy("source_no", "bucket").agg(F.sum(words).alias("words"))
        before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        own = Window.partitionBy("source_no", "bucket").orderBy("row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        laid = keyed.withColumn("inner", F.coalesce(F.sum(words).over(own), F.lit(0))).join(starts, ["source_no", "bucket"])
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
        laid = laid.select("doc_id", "row", "size", "source_no", (F.col("base") + F.col("inner")).alias("at"), copy)
        laid = laid.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
        b = F.lit(self.block_words)
        low, high = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
        cut = laid.withColumn("block", F.explode(F.sequence(low, high)))
        start = F.greatest(F.col("at"), F.col("block") * b)
        end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select(
            "source_no",
            "block",
            (start - F.col("block") * b).alias("place"),
            "at",
            "doc_id",
            "row",
            "size",
            (start - F.col("at")).alias("start"),
            (end - start).alias("n"),
        )

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for each row of the documents."""
        s = self.slots.select("source_no", "block", "words")
        p = self.pieces.join(s, ["source_no", "block"], "left")
        words = F.when(F.col("words") > F.col("place"), F.least(F.col("n"), F.col("words") - F.col("place"))).otherwise(0)
        used = p.groupBy("source_no", "at", "doc_id", "size").agg(F.sum(words).cast("long").alias("taken"))
        nums = self.sources.select("source_no", "source_size", "target")
        none = (
            self.sized.where("size = 0")
            .join(self._named(), F.col("source").eqNullSafe(F.col("named")))
            .select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        )
        return used.join(nums, "source_no").select("doc_id", "size", "source_size", "target", "taken").unionByName(none)

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(shard, slot, source_no, block, text, doc_ids): the words of each slot, joined by one space."""
        from cladeframe.llm.words import SPACE

        words = docs.select(
            F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("row"),
            F.filter(F.split(F.col(text_col), SPACE + "+"), lambda w: w != "").alias("ws"),
        ).dropDuplicates(["row"])
        parts = self.pieces.join(words, "row").select(
            "source_no", "block", "place", "doc_id", F.slice("ws", F.col("start").cast("int") + 1, F.col("n").cast("int")).alias("ws")
        )
        blocks = parts.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "ws"))).alias("parts"))
        whole = blocks.select(
            "source_no", "block", F.flatten(F.transform("parts", lambda p: p["ws"])).alias("ws"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids")
        )
        return self.slots.join(whole, ["source_no", "block"]).select(
            "shard", "slot", "source_no", "block", F.array_join(F.slice("ws", 1, F.col("words").cast("int")), " ").alias("text"), "doc_ids"
        )
