"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments.  The
Manhattan distance of two such vectors is never more than the Hamming distance
of the fingerprints, so it can rule pairs out.  The grid: the segments form
five blocks; vectors at distance 2 or less differ in two blocks at most, so
they share a unit cell of the grid over some three blocks.  Pairs within a
cell pass the Manhattan bound first and the exact Hamming test after it.

Equal fingerprints are one node from the start.  A cell with more than
``dense`` distinct fingerprints isn't joined with itself: its members go to a
grid of twice as many blocks, whose cells are smaller, and so on up to a block a
segment.  Every pair within the distance shares a cell of every grid, so none
is lost.  Cells that are crowded even there (thousands of fingerprints that
agree in 30 segments) are the rest: their members meet at the centres of
radius-1 balls (two fingerprints are within 2 bits of each other exactly when
those balls share a centre), each centre linking to its least member.  Those
links pass the same bound and test; they are linear in the members and connect
all that the pairs would.

Rows: a null text or one without words has fingerprint zero, linked like any
other; a null id is kept, is never a component's name unless the component has
no other id; rows with equal ids and repeated rows are each a row; a very long
text is hashed whole, its bits counted a block of shingles at a time; of equal
least ids (ties) in ``keep_one`` the row with the least hash stays; extra columns
are ignored or, in ``keep_one``, passed on; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize, spread
from cladeframe.llm.rows import NAMES, keep_rows, row_names
from cladeframe.llm.words import as_bytes, bound_batches, slices
from cladeframe.operators.components import connected_components

BITS = 64
LOW = 0x5555555555555555
BLOCKS, SEGMENTS = 5, 32
#: Runs of shingles whose bits are counted at a time.
PIECES = 512


def _fingerprints(texts: list, width: int, seed: int) -> np.ndarray:
    """SimHash of each text from the XXH64 of its word shingles."""
    out = np.zeros(len(texts), np.uint64)
    hash64 = xxhash.xxh64_intdigest
    for lo, hi in slices(texts, 1 << 20):
        values, counts = [], []
        for t in texts[lo:hi]:
            words = t.lower().split() if t else []
            if len(words) > width:
                own = zip(*(words[j:] for j in range(width)))
                n = len(words) - width + 1
            else:
                own, n = ([words], 1) if words else ([], 0)
            values.append(np.fromiter(map(hash64, map(b" ".join, own), repeat(seed)), np.uint64, n))
            counts.append(n)
        counts = np.array(counts, np.int64)
        h = np.concatenate(values)
        if not len(h):
            continue
        # A byte for each bit; runs of up to 255 rows add up without carry, eight bytes at a time.
        ends = np.cumsum(counts)
        begins = ends - counts
        pieces = np.concatenate([np.arange(a, b, 255) for a, b in zip(begins, ends)])
        stops = np.r_[pieces[1:], len(h)]
        sums = np.empty((len(pieces), 64), np.int32)
        for i in range(0, len(pieces), PIECES):
            first, last = pieces[i], stops[min(i + PIECES, len(pieces)) - 1]
            lanes = np.unpackbits(h[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
            sums[i : i + PIECES] = np.add.reduceat(lanes, pieces[i : i + PIECES] - first, axis=0).view(np.uint8)
        some = counts > 0
        first = np.searchsorted(pieces, begins[some])
        ones = np.add.reduceat(sums, first, axis=0)
        bits = (2 * ones > counts[some][:, None]).astype(np.uint8)
        own = np.zeros(hi - lo, np.uint64)
        own[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        out[lo:hi] = own
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, row, row2): the 64-bit SimHash of each row's word shingles, and two hashes of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fingerprints(as_bytes(b.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2), b.column(3)], names=["doc_id", "fp", "row", "row2"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).select("doc_id", "text", *row_names("doc_id", "text")).mapInArrow(run, "doc_id long, fp long, row long, row2 long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts_code(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each as a unary code of two bits.

    The Manhattan distance of two count vectors is the number of bits in which
    their codes differ.
    """
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW).cast("long")
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(high).bitwiseAND(low))


def grid_masks(blocks: int = BLOCKS, distance: int = 2) -> list[int]:
    """Bit masks of the subspaces of which at least one is equal within the distance."""
    cuts = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(own, blocks - distance)]


def grid_blocks(n: int, distance: int = 2) -> int:
    """Blocks for ``n`` fingerprints: of least expected rows, cells to emit and chance candidates together.

    Two random segments have equal counts with a chance of 3/8.
    """
    cost = lambda b: comb(b, distance) * (1 + n * 0.375 ** (32 * (b - distance) / b))
    return min(range(BLOCKS, 17), key=cost)


def _near(distance: int) -> Column:
    """Whether a and b are near: the Manhattan bound on their counts first, then the exact test."""
    bound = F.bit_count(counts_code(F.col("a")).bitwiseXOR(counts_code(F.col("b")))) <= distance
    return bound & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def _grid(fps: DataFrame, distance: int, dense: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs (a, b) of the cells of a grid, and the fingerprints of its crowded cells."""
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(grid_masks(blocks, distance)))))
    cells = fps.select("fp", counts_code(F.col("fp")).alias("code")).select("fp", at.alias("cell")).select("fp", "cell.grid", "cell.at")
    sizes = cells.groupBy("grid", "at").agg(F.count("*").alias("n")).where("n > 1")
    filled = materialize(cells.join(sizes, ["grid", "at"]), "simhash-cells")
    thin = filled.where(F.col("n") <= dense).select("grid", "at", "fp")
    pairs = thin.withColumnRenamed("fp", "a").join(thin.withColumnRenamed("fp", "b"), ["grid", "at"]).where("a < b")
    crowd = materialize(filled.where(F.col("n") > dense).select("fp").distinct(), "simhash-crowd")
    return pairs.where(_near(distance)).select("a", "b"), crowd


def _balls(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` within the distance, linear in their number."""
    flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    if distance < 2:
        near = fps.select(F.col("fp").alias("a"), F.explode(F.array(*flips)).alias("b")).join(fps.withColumnRenamed("fp", "b"), "b", "left_semi")
        return near.where(_near(distance)).select("a", "b")
    balls = fps.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("centre", "a")
    return balls.join(least, "centre").select("a", F.col("fp").alias("b")).where("a <> b").where(_near(distance))


def near_links(fps: DataFrame, distance: int = 2, dense: int = 64, blocks: int | None = None) -> DataFrame:
    """Links (src, dst) that connect all distinct ``fp`` within the distance of each other.

    Only ``distance`` 2 or less.  All links of thin cells; in the rest, stars of
    the same connectivity.  Each link is within the distance.
    """
    assert 0 <= distance <= 2
    blocks = blocks or grid_blocks(fps.count())
    links, crowd = _grid(fps, distance, dense, blocks)
    while blocks < SEGMENTS and not crowd.isEmpty():
        blocks = min(2 * blocks, SEGMENTS)
        more, crowd = _grid(crowd, distance, dense, blocks)
        links = links.unionByName(more)
    if not crowd.isEmpty():
        links = links.unionByName(_balls(crowd, distance))
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _classes(rows: DataFrame, distance: int, name: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, component) of each fingerprint, and (component, least) with the least ``name`` of its rows."""
    nodes = materialize(rows.groupBy("fp").agg(F.min(name).alias("least")), "simhash-nodes")
    found = connected_components(near_links(nodes, distance))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least"
    )
    return named.select("fp", "component"), named.groupBy("component").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least id reachable over links."""
    rows = materialize(fingerprints(docs, width, seed, id_col, text_col).drop(*NAMES), "simhash")
    classes, least = _classes(rows, distance, F.col("doc_id"))
    whole = classes.join(least, "component").select("fp", F.col("least").alias("component_id"))
    return rows.join(whole, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id of each component, with all its columns; one of rows that are repeated.

    Rows are told apart by 128 bits of hashes of id and text; a null id counts as
    the largest.
    """
    rows = materialize(fingerprints(docs, width, seed, id_col, text_col), "simhash")
    _, least = _classes(rows, distance, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *NAMES))
    gone = rows.select(*NAMES).distinct().join(least.select("least.row", "least.row2"), list(NAMES), "left_anti")
    return keep_rows(docs, gone, id_col, text_col)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
