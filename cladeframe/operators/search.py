"""All-against-all similarity search: seed join, local alignment, e-value, top targets.

Hits of another program can be read instead (``sources.tables.read_hits``); the
built-in search has the same output, but not that program's exact scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize, shuffle_partitions
from cladeframe.functions.strings import valid_kmer
from cladeframe.operators.events import member_blocks

#: Classes of amino acids that replace each other often: the scoring's rule.
CLASSES = ("AST", "C", "DE", "NQ", "G", "H", "ILMV", "FWY", "KR", "P")
GAP_OPEN, GAP_EXTEND = 11, 1
#: Of the scores of unrelated sequences under this matrix and these gaps: extreme values fitted to pairs of
#: random sequences of the usual composition (``tests/test_operators.py`` fits them anew).
LAMBDA, K = 0.37, 0.13


def scores() -> np.ndarray:
    """Substitution scores by byte: 5 for the same letter (more for rare ones), 1 within a class, else -2."""
    m = np.full((128, 128), -2, np.int32)
    for group in CLASSES:
        for a in group:
            for b in group:
                m[ord(a), ord(b)] = 1
    for group in CLASSES:
        for a in group:
            m[ord(a), ord(a)] = {"W": 11, "C": 9, "H": 8, "P": 7, "Y": 7, "F": 6, "G": 6, "D": 6, "N": 6}.get(a, 5)
    for c in "X*":
        m[ord(c), :] = m[:, ord(c)] = -1
    return m


#: Cells of a batch of alignments; a byte each is kept for the way back.
CELLS = 16_000_000
STOP, DIAGONAL, UP, LEFT, UP_OPENS, LEFT_OPENS = 0, 1, 2, 3, 4, 8


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8) & 127


def _fill(a: list[np.ndarray], b: list[np.ndarray], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores, their cells and the ways back of a batch of local alignments, a row of all at a time."""
    n, m, size = max(map(len, a)), max(map(len, b)), len(a)
    pad = matrix.copy()
    pad[0, :] = pad[:, 0] = -1000  # beyond a sequence's end
    q, t = np.zeros((size, n), np.uint8), np.zeros((size, m), np.uint8)
    for i, (x, y) in enumerate(zip(a, b)):
        q[i, : len(x)], t[i, : len(y)] = x, y
    h = np.zeros((size, m + 1), np.int32)
    up = np.full((size, m + 1), -(10**6), np.int32)
    left = np.full((size, m + 1), -(10**6), np.int32)
    col = np.arange(m + 1, dtype=np.int32) * GAP_EXTEND
    back = np.zeros((size, n + 1, m + 1), np.uint8)
    best, at = np.zeros(size, np.int64), np.zeros((size, 2), np.int64)
    every = np.arange(size)
    for i in range(1, n + 1):
        opened, further = h - (GAP_OPEN + GAP_EXTEND), up - GAP_EXTEND
        up = np.maximum(opened, further)
        row = np.zeros((size, m + 1), np.int32)
        row[:, 1:] = h[:, :-1] + pad[q[:, i - 1, None], t]
        code = np.where(row >= up, DIAGONAL, UP).astype(np.uint8)
        row = np.maximum(row, up)
        np.maximum(row, 0, out=row)
        left[:, 1:] = np.maximum.accumulate(row + col, axis=1)[:, :-1] - (GAP_OPEN + col[1:])
        code[left > row] = LEFT
        h = np.maximum(row, left)
        code[h <= 0] = STOP
        code[opened >= further] |= UP_OPENS
        code[:, 1:][left[:, 1:] == row[:, :-1] - (GAP_OPEN + GAP_EXTEND)] |= LEFT_OPENS
        h[:, 0] = 0
        back[:, i] = code
        j = h.argmax(axis=1)
        top = h[every, j]
        new = top > best
        best[new] = top[new]
        at[new, 0], at[new, 1] = i, j[new]
    return best, at, back


def _walk(i: int, j: int, back: np.ndarray) -> tuple[int, int, list[list]]:
    """Where an alignment that ends at a cell begins, and its runs of operations."""
    runs: list[list] = []
    state = "M"
    while True:
        code = int(back[i, j])
        if state == "M":
            step = code & 3
            if step == STOP:
                break
            if step != DIAGONAL:
                state = "I" if step == UP else "D"
                continue
            op, i, j = "M", i - 1, j - 1
        elif state == "I":  # a query column without a target character
            op, i = "I", i - 1
            state = "M" if code & UP_OPENS else "I"
        else:
            op, j = "D", j - 1
            state = "M" if code & LEFT_OPENS else "D"
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return i, j, runs[::-1]


def align_all(pairs: list[tuple[str, str]], matrix: np.ndarray) -> list[tuple[int, int, int, int, int, str] | None]:
    """(score, qstart, qend, sstart, send, cigar) of each pair, 1-based and inclusive: its best local alignment, or None."""
    out: list = [None] * len(pairs)
    codes = [(_codes(x), _codes(y)) for x, y in pairs]
    order = sorted((k for k, (x, y) in enumerate(codes) if len(x) and len(y)), key=lambda k: (len(codes[k][0]), len(codes[k][1])))
    while order:
        n = m = 0
        take = 0
        for k in order:
            n, m = max(n, len(codes[k][0]) + 1), max(m, len(codes[k][1]) + 1)
            if take and (take + 1) * n * m > CELLS:
                break
            take += 1
        some, order = order[:take], order[take:]
        best, at, back = _fill([codes[k][0] for k in some], [codes[k][1] for k in some], matrix)
        for x, k in enumerate(some):
            if best[x] > 0:
                i, j = map(int, at[x])
                qs, ss, runs = _walk(i, j, back[x])
                out[k] = (int(best[x]), qs + 1, i, ss + 1, j, "".join(f"{r}{op}" for r, op in runs))
    return out


def local_alignment(query: str, target: str, matrix: np.ndarray) -> tuple[int, int, int, int, str] | None:
    """(score, qstart, qend, sstart, cigar) of one pair."""
    got = align_all([(query, target)], matrix)[0]
    return None if got is None else (*got[:4], got[5])


_SWAP = str.maketrans("ID", "DI")


#: Occurrences beyond which a seed is replaced by the longer ones that start with it.
HOT = 500
#: Diagonals of a band; bands overlap by half.
BAND = 16


def seed_postings(protein: DataFrame, seed: int = 5, hot: int = HOT, min_distinct: int = 3) -> DataFrame:
    """(key, size, protein_id, pos): where the seeds of each sequence stand, an inverted index by the seed's hash.

    Seeds of few distinct letters or with an unknown one are masked.  A seed with
    more than ``hot`` occurrences is longer wherever it occurs: twice its size, then
    four, then eight times, or as far as the sequence goes.  So a motif that
    every sequence holds is told apart by what follows it, and lists of rows that
    go together by chance stay short.
    """
    seqs = protein.select("protein_id", F.upper("seq").alias("seq"))

    def of_size(k: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length("seq") - seed + 1)
        words = seqs.where(F.length("seq") >= seed).select("protein_id", F.posexplode(F.transform(starts, lambda i: F.substring("seq", i, F.lit(k)))).alias("pos", "word"))
        words = words.where(valid_kmer(F.substring("word", 1, seed), min_distinct))
        return words.select(F.xxhash64("word").alias("key"), F.length("word").alias("size"), "protein_id", "pos", F.xxhash64(F.substring("word", 1, k // 2)).alias("half"))

    out, common, k = None, None, seed
    while k <= 8 * seed:
        level = of_size(k)
        if common is not None:
            level = level.join(common.withColumnRenamed("key", "half"), "half", "left_semi")
        if k < 8 * seed:
            # written: a row for each ``hot`` occurrences at most
            common = materialize(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot-seeds")
            level = level.join(common, "key", "left_anti")
        level = level.select("key", "size", "protein_id", "pos")
        out = level if out is None else out.unionByName(level)
        k *= 2
    return out


def candidates(protein: DataFrame, seed: int = 5, hot: int = HOT, band: int = BAND) -> DataFrame:
    """(query, target), query <= target: sequences with two seeds on one band of diagonals, and each with itself.

    Seeds meet by their hash, pairs are counted by (query, target, band) on the map
    side, and no sequence is fetched before.  A longer seed counts for two.  Lists of
    seeds that are common even so are dealt into pairs of blocks.
    """
    posts = materialize(seed_postings(protein, seed, hot), "postings")
    sides = member_blocks(posts.withColumn("at", F.struct("protein_id", "pos")), ["key", "size"], "at", [])
    left, right = (df.select("key", "size", "i", "j", F.col(f"{c}.protein_id").alias(c + "p"), F.col(f"{c}.pos").alias(c + "x")) for df, c in zip(sides, "uv"))
    met = left.join(right, ["key", "size", "i", "j"]).where((F.col("up") < F.col("vp")) | (F.col("i") < F.col("j")) & (F.col("up") != F.col("vp")))
    first = F.col("up") < F.col("vp")
    met = met.select(
        F.least("up", "vp").alias("query"), F.greatest("up", "vp").alias("target"), "size",
        F.when(first, F.col("ux")).otherwise(F.col("vx")).alias("x"), (F.when(first, F.lit(1)).otherwise(-1) * (F.col("ux") - F.col("vx"))).alias("diagonal"),
    )
    half = F.floor(F.col("diagonal") / (band // 2))
    near = met.select("query", "target", F.explode(F.array(half - 1, half)).alias("band"), "x", "size")
    two = near.groupBy("query", "target", "band").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.max("size").alias("size"))
    pairs = two.where((F.col("least") < F.col("most")) | (F.col("size") > seed)).select("query", "target").distinct()
    return pairs.unionByName(protein.select(F.col("protein_id").alias("query"), F.col("protein_id").alias("target")))


def search(protein: DataFrame, e_value: float = 0.001, nb_hits: int = 6, seed: int = 5) -> DataFrame:
    """(query, target, qstart, qend, sstart, cigar, ord): the best targets of each query in each species.

    The query itself takes a place in its own species.  Ranked by score, ties by
    target; a hit's e-value is against its target's species.
    """
    sizes = protein.groupBy("species_id").agg(F.sum(F.length("seq")).alias("db"))
    known = protein.select("protein_id", "seq", "species_id").join(sizes, "species_id")
    full = (
        candidates(protein, seed)
        .join(known.toDF("qsp", "query", "qseq", "qdb"), "query")
        .join(known.toDF("tsp", "target", "tseq", "tdb"), "target")
        .select("query", "target", "qsp", "tsp", "qseq", "tseq", "qdb", "tdb")
        .repartition(shuffle_partitions(protein.sparkSession), "query", "target")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = scores()
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            rows = list(zip(*(b.column(i).to_pylist() for i in range(8))))
            made = align_all([(r[4] or "", r[5] or "") for r in rows], matrix)
            for (q, t, qsp, tsp, qs, ts, qdb, tdb), got in zip(rows, made):
                if got is None:
                    continue
                score, a, z, c, d, cigar = got
                # one alignment serves both directions; each has its own e-value
                ways = [(q, t, tsp, len(qs) * tdb, a, z, c, cigar)]
                if q != t:
                    ways.append((t, q, qsp, len(ts) * qdb, c, d, a, cigar.translate(_SWAP)))
                for query, target, sp, space, start, end, other, path in ways:
                    if K * space * math.exp(-LAMBDA * score) <= e_value:
                        for o, v in zip(out, (query, target, sp, score, start, end, other, path)):
                            o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["query", "target", "species_id", "score", "qstart", "qend", "sstart", "cigar"])

    found = full.mapInArrow(run, "query long, target long, species_id int, score int, qstart int, qend int, sstart int, cigar string")
    w = Window.partitionBy("query", "species_id").orderBy(F.col("score").desc(), "target")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= nb_hits)
        .select("query", "target", "qstart", "qend", "sstart", "cigar", F.lit(1).alias("ord"))
    )
