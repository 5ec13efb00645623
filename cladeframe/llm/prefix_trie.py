"""The trie of all prefixes of conversations, by naming blocks of doubling length.

Equal turns get equal numbers (dense names), then equal pairs of neighbouring
blocks, so that after k rounds each aligned block of 2**k turns has a name that
equal blocks share.  A prefix is made of such blocks by the binary digits of its
length: its name is that of the pair (prefix without the last block, last block),
taken for all lengths that end in the same block size at once.  So names of all
prefixes take about twice the logarithm of the longest conversation in rounds, and
the rows of all rounds together are some times the turns.

Nodes are then groups of equal (depth, name).  Sums over subtrees need no walk up
the trie: each node is owned by its smallest member, the nodes that a conversation
owns lie on its own path, and the sum of a subtree is that of what its members own
from the node's depth on.

Numbering within a conversation and sums along it are taken in two levels, so that
a conversation of any length is the work of many tasks; the list of conversations
that end in a node is hashed as a stream of sorted pieces of bounded length.

Rows: a null role or text is empty; turns are ordered by number, null first, then
by role and text, repeated rows one after the other; rows with a null conversation
belong to none and are left out; an empty table has no nodes, not even a root;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import discard, materialize
from cladeframe.llm.words import word_count

#: Turns of a conversation, and ids in a list, that are put together in one piece.
PIECE = 4096


def dense_names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): distinct keys numbered from 0 without a gap, in no special order.

    Each task numbers its own; the counts of the tasks before it are added, a table of one row a task.
    """
    own = materialize(rows.select(*keys).distinct().withColumn("__id", F.monotonically_increasing_id()), "names")
    part, place = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = own.withColumn("__part", part).join(shift, "__part").select(*keys, (place + F.col("__before")).alias(name))
    out._cladeframe_path = own._cladeframe_path
    return out


def _named(rows: DataFrame, keys: list[str], name: str, keep: list[str]) -> DataFrame:
    """``rows`` with the dense name of their keys, written."""
    names = dense_names(rows, keys, name)
    out = materialize(rows.join(names, keys).select(*keep, name), "named")
    discard(names)
    return out


def turn_digest(role: Column, text: Column) -> Column:
    """256 bits that stand for a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words): turns numbered from 1 within their conversation; texts move once."""
    c, t, r, x = (F.col(f"`{n}`") for n in (conv_col, turn_col, role_col, text_col))
    rows = conversations.select(c.cast("long").alias("conv"), t.alias("turn"), F.coalesce(r.cast("string"), F.lit("")).alias("role"), F.coalesce(x.cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # equal rows may go anywhere, so that many of them are split as well
    dealt = rows.where("conv IS NOT NULL").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("tie")).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("conv", turn_digest(F.col("role"), F.col("text")).alias("digest"), word_count(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("id")), "turns")
    dealt = dealt.withColumn("part", F.shiftrightunsigned("id", 33))
    parts = dealt.groupBy("conv", "part").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least") + 1).alias("shift"))
    return dealt.join(parts, ["conv", "part"]).select("conv", (F.col("id") + F.col("shift")).alias("pos"), "digest", "words")


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation c starts with turns of conversation c - c % ``every``.

    Its own first h turns, h = crc32(decimal c) % ``most``, are replaced by the
    first h turns of that conversation, by as many as there are.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = sizes.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    found = sizes.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    plan = base.join(found, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    own = turns.where(F.col("pos") > h).join(plan, "conv").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    added = plan.join(heads, "base").where("pos <= taken").select("conv", "pos", "digest", "words")
    return own.unionByName(added), sizes.select("conv")


def _blocks(turns: DataFrame) -> list[DataFrame]:
    """For each k the names (conv, i, name) of the aligned blocks i of 2**k turns."""
    out = [_named(turns.select("conv", (F.col("pos") - 1).alias("i"), "digest"), ["digest"], "name", ["conv", "i"])]
    longest = out[0].agg(F.max("i")).first()[0]
    while longest is not None and longest + 1 >= 1 << len(out):
        two = out[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("x"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("y")
        )
        out.append(_named(two.where("x IS NOT NULL AND y IS NOT NULL"), ["x", "y"], "name", ["conv", "i"]))
    return out


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, depth, name) for each prefix of one turn or more; equal prefixes have equal depth and name."""
    blocks = _blocks(turns)
    known = None  # prefixes that end in a larger block
    for k in reversed(range(len(blocks))):
        last = blocks[k].where("i % 2 = 0").select("conv", F.shiftleft("i", k).alias("start"), F.col("name").alias("block"))
        root = last.where("start = 0").withColumn("before", F.lit(-1).cast("long"))
        pairs = root
        if known is not None:
            pairs = pairs.unionByName(last.where("start > 0").join(known.select("conv", F.col("depth").alias("start"), F.col("name").alias("before")), ["conv", "start"]))
        pairs = pairs.select("conv", (F.col("start") + (1 << k)).alias("depth"), "before", "block")
        named = _named(pairs, ["depth", "before", "block"], "name", ["conv", "depth"])
        known = named if known is None else known.unionByName(named)
    for b in blocks:
        discard(b)
    return known


def _hash_lists(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of the ascending, comma-joined conversations of each (depth, name).

    Lists are cut into pieces of ids from a range of ``PIECE``; the pieces of a
    node pass through one task in order, of which it holds one batch.
    """
    pieces = ends.groupBy("depth", "name", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "piece").select("depth", "name", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            depths, names, texts = [], [], []
            for *now, ids in zip(*(c.to_pylist() for c in b.columns)):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    depths.append(key[0])
                    names.append(key[1])
                    texts.append(state.hexdigest())
                key, state = now, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(depths, pa.int64()), pa.array(names, pa.int64()), pa.array(texts, pa.string())], names=["depth", "name", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["depth", "name", "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, name long, ends_sha256 string")


def _sums_to_the_end(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with each value replaced by its sum over the conversation from that depth on."""
    piece = F.floor(F.col("depth") / PIECE)
    rows = rows.withColumn("piece", piece)
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv", "piece").agg(*(F.sum(v).alias(v) for v in values))
    pieces = pieces.select("conv", "piece", *(F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"{v}_later") for v in values))
    own = Window.partitionBy("conv", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({v: F.sum(v).over(own) for v in values}).join(pieces, ["conv", "piece"])
    return sums.withColumns({v: F.col(v) + F.col(f"{v}_later") for v in values}).drop("piece", *(f"{v}_later" for v in values))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv, pos, digest, words), with the root of all ``conversations`` (conv).

    conv_id: smallest member; depth; parent_conv_id: that of the parent; n_convs:
    members; n_children; n_leaves: childless nodes of the subtree; saved_tokens:
    words of the subtree's turns that are shared, once for each member but one;
    ends_sha256: hash of the members that end here.
    """
    turns = materialize(turns, "trie-turns")
    names = prefix_names(turns)
    above = names.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    below = names.join(turns.select("conv", F.col("pos").alias("depth"), "words"), ["conv", "depth"]).join(above, ["conv", "depth"], "left")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.select("conv", zero.alias("depth"), zero.alias("name"), zero.alias("words"), none.alias("parent"))
    paths = materialize(below.select("conv", "depth", "name", "words", F.coalesce("parent", zero).alias("parent")).unionByName(root), "paths")

    nodes = paths.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("parent").alias("parent"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", zero))

    own = nodes.select("conv", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    values = ["n_leaves", "saved_tokens"]
    rows = paths.select("conv", "depth", "name").join(own, ["conv", "depth"], "left").na.fill(0, values)
    trees = _sums_to_the_end(rows, values).groupBy("depth", "name").agg(*(F.sum(v).alias(v) for v in values))

    last = paths.groupBy("conv").agg(F.max(F.struct("depth", "name")).alias("last"))
    ends = _hash_lists(last.select("conv", "last.depth", "last.name"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "parent"], "left").join(trees, ["depth", "name"]).join(ends, ["depth", "name"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *values,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
