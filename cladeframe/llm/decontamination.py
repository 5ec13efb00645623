"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and benchmark items are normalised (lower case, runs of ASCII
punctuation and white space to one space).  For each length in ``windows`` an
item has overlapping needles of it, or is one itself if shorter, so a copied
part is found.  A region within k edits of a needle of length w shares
at least w - q + 1 - k q of its q-grams with it, all on diagonals within k of
each other, so they fall in one of the overlapping bands that are 2 k + 1 wide
and k + 1 apart.  Bands that reach the bound are retained and verified by an
alignment in a band around their diagonals.

Texts are scanned where they are read: a narrow pass, without a shuffle.  The
benchmark is dealt into groups of ``group_bytes`` of text; each group's index is
broadcast, so what is broadcast is bounded however large the benchmark is, and a
further group is a further pass.

Needles start every quarter of their length, so an exact copy of 79 characters of
an item always holds a whole one; shorter parts are found by where they begin.

Rows: a null or empty text has no hits; a null or empty item, or one of fewer than
``q`` normalised characters, matches nothing; items too short for an edit must
match whole; repeated items and rows count each; of several hits (ties) all are
rows, merged where they overlap; a very long text is searched whole, alone; an
empty table, of documents or of items, gives no hits; extra columns are passed on
by :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import spread
from cladeframe.llm.words import as_bytes, bound_batches, slices

Q = 10
#: Lengths of needles and the share of them that edits may change: short ones find parts of an
#: item, long ones bear a changed word.
WINDOWS = ((100, 0.08), (64, 0.0625))
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SLOTS = 22


def normalise(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and the place of each of them in ``text`` lower-cased."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    b = np.frombuffer(low.translate(_SPACES), np.uint8)
    space = b == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of spaces the first stays
    at = np.flatnonzero(keep)
    return b[at], at


def _codes(b: np.ndarray) -> np.ndarray:
    """A hash of each run of Q bytes."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(b) - 7,), "<u8", np.ascontiguousarray(b), strides=(1,))
    return eight[:n] * _MIX1 + eight[Q - 8 : Q - 8 + n] * _MIX2


class Index:
    """Needles of a group of items, and the postings of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], windows: tuple[tuple[int, float], ...] = WINDOWS):
        self.items = []  # id, text, needles: (start, length, edits, q-grams that must be shared)
        codes, owner, place = [], [], []
        for item_id, text in items:
            b, _ = normalise(text or b"")
            b = np.frombuffer(b.tobytes().strip(), np.uint8)
            if len(b) < Q:
                continue
            c = _codes(b)
            owner.append(np.full(len(c), len(self.items), np.int32))
            place.append(np.arange(len(c), dtype=np.int32))
            codes.append(c)
            needles = {}
            for window, rate in windows:
                w = min(len(b), window)
                k = min(int(rate * w), max(0, (w - Q) // Q))
                for start in {*range(0, len(b) - w + 1, max(1, window // 4)), len(b) - w}:
                    needles[start, w] = max(k, needles.get((start, w), 0))
            self.items.append((item_id, b.tobytes(), [(start, w, k, w - Q + 1 - k * Q) for (start, w), k in sorted(needles.items())]))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        codes, owner, place = cat(codes, np.uint64), cat(owner, np.int32), cat(place, np.int32)
        order = np.argsort(codes, kind="stable")
        codes, self.owner, self.place = codes[order], owner[order], place[order]
        self.codes, self.first = np.unique(codes, return_index=True)
        self.count = np.diff(np.r_[self.first, len(codes)])
        # of an item: the least bound of its needles, and the largest budget, which sets the bands
        self.bound = np.array([min(n[3] for n in needles) for _, _, needles in self.items], np.int64)
        self.budget = np.array([max(n[2] for n in needles) for _, _, needles in self.items], np.int64)
        self.filter = np.zeros(1 << SLOTS, bool)
        self.filter[self.slot(self.codes)] = True

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - SLOTS)).astype(np.int64)

    def search(self, texts: list) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, shared q-grams); places in the lower-cased text's bytes."""
        out = []
        if not self.items:
            return out
        for lo, hi in slices(texts):
            parts, maps, size = [], [], []
            for t in texts[lo:hi]:
                b, at = normalise(t or b"")
                parts.append(b)
                maps.append(at)
                size.append(len(b) + Q)
                parts.append(np.zeros(Q, np.uint8))  # no q-gram of two texts matches
            flat = np.concatenate(parts)
            begin = np.r_[0, np.cumsum(size)]
            codes = _codes(flat)
            hit = np.flatnonzero(self.filter[self.slot(codes)])
            got = codes[hit]
            k = np.minimum(np.searchsorted(self.codes, got), len(self.codes) - 1)
            real = self.codes[k] == got
            hit, k = hit[real], k[real]
            out += self._bands(hit, k, flat, begin, maps, lo)
        return out

    def _bands(self, hit, k, flat, begin, maps, lo) -> list:
        n = self.count[k]
        pos = np.repeat(hit, n)
        post = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        item, j = self.owner[post].astype(np.int64), self.place[post].astype(np.int64)
        docs = len(begin)
        doc = np.repeat(np.searchsorted(begin, hit, side="right") - 1, n)
        diag = pos - j
        step = self.budget[item] + 1
        band = diag // step
        # A band holds two steps of diagonals; each diagonal lies in two bands.  Those of a document are its own.
        key = (np.concatenate([band, band - 1]) * len(self.items) + np.concatenate([item, item])) * docs + np.concatenate([doc, doc])
        j2, p2 = np.concatenate([j, j]), np.concatenate([pos, pos])
        if not len(key):
            return []
        _, inv, total = np.unique(key, return_inverse=True, return_counts=True)
        enough = total[inv] >= self.bound[np.concatenate([item, item])]
        if not enough.any():
            return []
        key, j2, p2 = key[enough], j2[enough], p2[enough]
        order = np.lexsort((j2, key))
        key, j2, p2 = key[order], j2[order], p2[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, i = int(key[a] % docs), int(key[a] // docs % len(self.items))
            _, text, needles = self.items[i]
            js, ps = j2[a:b], p2[a:b]
            left, right = int(begin[at]), int(begin[at + 1]) - Q
            for s, w, budget, need in needles:
                x, y = np.searchsorted(js, s), np.searchsorted(js, s + w - Q, side="right")
                if y - x < need or len(np.unique(js[x:y])) < need:
                    continue
                d = ps[x:y] - js[x:y]
                got = banded(text[s : s + w], flat[left:right].tobytes(), int(d.min()) + s - left, int(d.max()) + s - left, budget)
                if got is not None:
                    found.setdefault((at, i), []).append((*got, int(y - x)))
        return [
            (lo + at, self.items[i][0], int(maps[at][start]), int(maps[at][end - 1]) + 1, edits, shared)
            for (at, i), regions in found.items()
            for start, end, edits, shared in merged(regions)
        ]


def merged(regions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Regions (start, end, edits, shared) with those that overlap made one: the fewest edits, the most shared."""
    out: list[list[int]] = []
    for start, end, edits, shared in sorted(regions):
        if out and start < out[-1][1]:
            last = out[-1]
            last[1:] = max(last[1], end), min(last[2], edits), max(last[3], shared)
        else:
            out.append([start, end, edits, shared])
    return [tuple(r) for r in out]


def banded(needle: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best place of ``needle`` in ``text`` within ``budget`` edits, its start on diagonals low..high
    widened by the budget: (start, end, edits), or None."""
    low, high = low - budget, high + budget
    for d in range(max(0, low), high + 1):  # an exact copy is the usual case
        if text.startswith(needle, d):
            return d, d + len(needle), 0
    if budget == 0:
        return None
    width = high - low + 1
    far = budget + 1
    # cost and start of the alignment that ends at needle[:i], text[: low + i + c]
    cost = [0 if low + c >= 0 else far for c in range(width)]
    start = [low + c for c in range(width)]
    for i, ch in enumerate(needle):
        new, begin = [far] * width, [0] * width
        for c in range(width):
            p = low + i + c  # the character of the text on this diagonal
            best, at = far, 0
            if 0 <= p < len(text) and cost[c] + (text[p] != ch) < best:
                best, at = cost[c] + (text[p] != ch), start[c]
            if c + 1 < width and cost[c + 1] + 1 < best:
                best, at = cost[c + 1] + 1, start[c + 1]
            if c and 0 <= p < len(text) and new[c - 1] + 1 < best:
                best, at = new[c - 1] + 1, begin[c - 1]
            new[c], begin[c] = best, at
        cost, start = new, begin
        if min(cost) > budget:
            return None
    c = min(range(width), key=lambda x: (cost[x], start[x]))
    end = low + len(needle) + c
    return (start[c], min(end, len(text)), cost[c]) if cost[c] <= budget and end > start[c] else None


def indexes(bench: DataFrame, windows: tuple[tuple[int, float], ...], group_bytes: int, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over groups of items of about ``group_bytes`` each."""
    bound_batches(bench.sparkSession)
    items = bench.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else items
        got = sorted(((r[0], r[1].encode()) for r in rows.collect()), key=lambda x: (x[0] is None, x))
        yield Index(got, windows)


def contamination(docs: DataFrame, bench: DataFrame, windows: tuple[tuple[int, float], ...] = WINDOWS, group_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, shared): every region of each row that is near a needle of an item.

    Regions of an item that overlap are one row, with the fewest edits and the most shared
    q-grams of its needles.  start and end are byte places in the lower-cased text, end exclusive.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    out = None
    for index in indexes(bench, windows, group_bytes, "item_id", "text"):
        known = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = known.value.search(as_bytes(b.column(1)))
                ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([f[c] for f in found], pa.int64()) for c in range(1, 6))],
                    names=["doc_id", "item_id", "start", "end", "edits", "shared"],
                )

        got = rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long, shared long")
        out = got if out is None else out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, windows: tuple[tuple[int, float], ...] = WINDOWS, group_bytes: int = 4 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    spark, docs = docs.sparkSession, spread(docs)
    for index in indexes(bench, windows, group_bytes, "item_id", "text"):
        known = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in known.value.search(as_bytes(b.column(b.schema.get_field_index(text_col))))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
