"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words.

Plan.  Rows are dealt once to chunks of some megabytes of text by a hash of
the row.  Each chunk hashes all its windows and reduces them to one entry for
each distinct hash, with the least id that starts it (the pre-aggregation, so
a passage in a third of all rows is one entry a chunk).  Entries travel as
packed arrays, about eight bytes a window, to buckets by hash range, where
occurrences are counted over all chunks.  A bucket answers a chunk only with
those hashes that start in a smaller id elsewhere.  The chunk, read from the
same shuffle files as before, marks the windows and merges overlapping ones
into maximal removal intervals.  Nothing is gathered by key: the largest group
anywhere is a chunk or a bucket.

At 100 TB a chunk has 128 MB of text and a bucket as much, so a piece that goes
from one to the other is some hundreds of bytes; a task takes many of them, one
after the other.  A worker works through a chunk or a bucket by ranges of hashes
and holds some 20 bytes a window.

Windows are compared by a 64-bit hash; two different windows among n collide
with a chance of about n / 2**64 each.

Rows: a null text has no words; a null id counts as the largest of all, so it
never makes another row lose words; rows with equal ids (repeated rows among
them, ties) don't affect each other, and each loses what it would lose alone;
repeated rows are dealt apart by the partition they are read in; texts shorter
than a window lose nothing; a very long text is hashed whole; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import shuffle_partitions
from cladeframe.llm.words import WordHashes, as_bytes, rolling, slices, starts_within

LAST = np.iinfo(np.int64).max
OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
#: Windows that a worker sorts at a time, and partitions of an exchange.
RANGE, MOST_TASKS = 1 << 21, 20_000


def chunk_count(total_bytes: int, least: int) -> int:
    """Chunks of 6 MB of text or, for very large inputs, larger ones up to 128 MB, so that
    the pieces exchanged between chunks and buckets stay above some hundred bytes."""
    size = min(max(6 << 20, int((total_bytes * 256) ** 0.5)), 128 << 20)
    return max(1, least, -(-total_bytes // size))


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as their differences, in as many bytes each as the largest needs."""
    gaps = np.diff(h, prepend=np.uint64(0))
    gaps[0] = 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return h[:1].tobytes() + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(b: pa.Buffer, n: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:1] = np.frombuffer(b, np.uint8, 8)
    if n > 1:
        rest = np.frombuffer(b, np.uint8, offset=8).reshape(n - 1, -1)
        gaps[1:, : rest.shape[1]] = rest
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


class _Rows:
    """A chunk's rows by id, nulls last; ``rank`` tells ids apart and keeps their order."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id")
        null = np.asarray(ids.is_null())
        ids = ids.fill_null(LAST).to_numpy().astype(np.int64)
        order = np.lexsort((ids, null))
        texts = as_bytes(t.column("text"))
        self.texts = [texts[i] for i in order]
        self.ids, self.null = ids[order], null[order]
        new = (self.ids[1:] != self.ids[:-1]) | (self.null[1:] != self.null[:-1])
        self.rank = np.r_[0, np.cumsum(new)].astype(np.uint32)[: len(ids)]

    def parts(self) -> int:
        """Into how many ranges of hashes to cut the work: a power of two."""
        return 1 << max(0, (sum(len(x or b"") for x in self.texts) // (4 * RANGE)).bit_length())


def _by_range(hashes: np.ndarray, parts: int) -> list[np.ndarray]:
    """Places of the hashes of each range, in order."""
    if parts == 1:
        return [np.arange(len(hashes))]
    which = (hashes >> np.uint64(64 - (parts - 1).bit_length())).astype(np.uint16)
    order = np.argsort(which, kind="stable")
    return np.split(order, np.searchsorted(which[order], np.arange(1, parts)))


def _windows(texts: list, width: int, table: WordHashes):
    """For runs of texts: first index, words of each text, hash of each window, its text's index."""
    for lo, hi in slices(texts):
        words = [t.split() if t else [] for t in texts[lo:hi]]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        hashes = rolling(table.of([w for x in words for w in x]), width)
        ok = starts_within(counts, width)
        yield lo, words, counts, hashes, ok


def _owners(lo: int, counts: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The row of each window that lies within one."""
    return np.repeat(np.arange(lo, lo + len(counts), dtype=np.uint32), counts)[: len(ok)][ok]


def _reduce_chunk(width: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        docs, table = _Rows(t), WordHashes()
        parts = docs.parts()
        held: list[list] = [[] for _ in range(parts)]
        for lo, _, counts, hashes, ok in _windows(docs.texts, width, table):
            h, d = hashes[ok], _owners(lo, counts, ok)
            for r, at in enumerate(_by_range(h, parts)):
                held[r].append((h[at], d[at]))
        small = np.uint16 if len(docs.ids) < 65536 else np.uint32
        chunk = t.column("chunk")[0].as_py()
        rows = {"bucket": [], "chunk": [], "n": [], "hashes": [], "owners": [], "ids": [], "nulls": []}
        for r in range(parts):
            if not held[r]:
                continue
            h, d = (np.concatenate(x) for x in zip(*held[r]))
            held[r] = []
            h, first = np.unique(h, return_index=True)  # the first has the least id
            d = d[first]
            if not len(h):
                continue
            low, high = int(h[0]) * buckets >> 64, int(h[-1]) * buckets >> 64
            edges = np.array([-(-(k << 64) // buckets) for k in range(low + 1, high + 1)], dtype=np.uint64)
            cuts = [0, *np.searchsorted(h, edges), len(h)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), low):
                if a < b:
                    own, back = np.unique(d[a:b], return_inverse=True)
                    rows["bucket"].append(k)
                    rows["chunk"].append(chunk)
                    rows["n"].append(int(b - a))
                    rows["hashes"].append(_pack(h[a:b]))
                    rows["owners"].append(back.astype(small).tobytes())
                    rows["ids"].append(docs.ids[own].tobytes())
                    rows["nulls"].append(docs.null[own].tobytes() if docs.null[own[-1]] else b"")
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return run


def _count_bucket(t: pa.Table) -> pa.Table:
    """For each chunk, the hashes that start in a smaller id of another chunk."""
    chunks, sizes = t.column("chunk").to_pylist(), t.column("n").to_pylist()
    packed, owners, ids, nulls = (t.column(c) for c in ("hashes", "owners", "ids", "nulls"))
    hashes = [_unpack(packed[i].as_buffer(), n) for i, n in enumerate(sizes)]
    low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes)
    parts = -(-sum(sizes) // RANGE)
    edges = np.array([low + (high - low + 1) * r // parts for r in range(1, parts)], dtype=np.uint64)
    cuts = [np.r_[0, np.searchsorted(h, edges), len(h)] for h in hashes]
    lost_of: dict[int, list] = {}
    for r in range(parts):
        at = [(i, int(c[r]), int(c[r + 1])) for i, c in enumerate(cuts) if c[r] < c[r + 1]]
        if not at:
            continue
        h = np.concatenate([hashes[i][a:b] for i, a, b in at])
        row = np.repeat(np.array([i for i, _, _ in at], np.int32), [b - a for _, a, b in at])
        place = np.concatenate([np.arange(a, b, dtype=np.int32) for _, a, b in at])
        order = np.argsort(h, kind="stable")
        h = h[order]
        again = h[1:] == h[:-1]
        shared = np.r_[False, again] | np.r_[again, False]
        h, row, place = h[shared], row[order[shared]], place[order[shared]]
        if not len(h):
            continue
        d, null = np.empty(len(h), np.int64), np.zeros(len(h), bool)
        for i in np.unique(row):
            mine = row == i
            o = owners[int(i)].as_buffer()
            own = np.frombuffer(o, np.uint16 if o.size == 2 * sizes[i] else np.uint32)[place[mine]]
            d[mine] = np.frombuffer(ids[int(i)].as_buffer(), np.int64)[own]
            flags = nulls[int(i)].as_buffer()
            if flags.size:
                null[mine] = np.frombuffer(flags, bool)[own]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[begin, len(h)])
        least = np.repeat(np.minimum.reduceat(d, begin), size)  # a null is LAST, so it makes nothing smaller
        real = np.repeat(np.logical_or.reduceat(~null, begin), size)
        lost = np.where(null, real, d > least)
        h, row = h[lost], row[lost]
        for i in np.unique(row):
            lost_of.setdefault(chunks[i], []).append(h[row == i])
    told = {c: np.concatenate(v) for c, v in lost_of.items()}
    return pa.table([pa.array(list(told), pa.int32()), pa.array([v.tobytes() for v in told.values()], pa.binary())], names=["chunk", "hashes"])


def _bad_windows(docs: _Rows, lost: np.ndarray, width: int) -> np.ndarray:
    """Which windows of a chunk, row after row, also start in a smaller id."""
    table, parts = WordHashes(), docs.parts()
    held: list[list] = [[] for _ in range(parts)]
    total = 0
    for lo, _, counts, hashes, ok in _windows(docs.texts, width, table):
        h, d = hashes[ok], _owners(lo, counts, ok)
        for r, at in enumerate(_by_range(h, parts)):
            held[r].append((h[at], docs.rank[d[at]], (total + at).astype(np.uint32)))
        total += len(h)
    bad = np.zeros(total, bool)
    for r in range(parts):
        if not held[r]:
            continue
        h, rank, place = (np.concatenate(x) for x in zip(*held[r]))
        held[r] = []
        if len(lost) and len(h):
            at = np.minimum(np.searchsorted(lost, h), len(lost) - 1)
            bad[place[lost[at] == h]] = True
        by = np.argsort(h, kind="stable")
        s = h[by]
        again = s[1:] == s[:-1]
        shared = np.r_[False, again] | np.r_[again, False] if len(s) else np.zeros(0, bool)
        k = by[shared]
        if len(k):
            s = s[shared]
            begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            mine = rank[k]
            bad[place[k]] |= mine > np.repeat(np.minimum.reduceat(mine, begin), np.diff(np.r_[begin, len(s)]))
    return bad


def _cut_chunk(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        elsewhere = [np.frombuffer(x.as_buffer(), np.uint64) for x in told.column("hashes")]
        lost = np.sort(np.concatenate(elsewhere)) if elsewhere else np.empty(0, np.uint64)
        docs = _Rows(rows)
        bad = _bad_windows(docs, lost, width)
        out = {"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept_text": []}
        done = 0
        for i, t in enumerate(docs.texts):
            words = t.split() if t else []
            n = max(0, len(words) - width + 1)
            hit = np.flatnonzero(bad[done : done + n])
            done += n
            spans, gone = [], 0
            if len(hit):
                brk = np.flatnonzero(np.diff(hit) > width)  # windows that touch or overlap become one interval
                a, b = hit[np.r_[0, brk + 1]], hit[np.r_[brk, len(hit) - 1]] + width
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]
                gone = int((b - a).sum())
                keep = np.ones(len(words), bool)
                for x, y in zip(a, b):
                    keep[x:y] = False
                words_kept = compress(words, keep.tolist())
            else:
                words_kept = words
            out["doc_id"].append(None if docs.null[i] else int(docs.ids[i]))
            out["n_words"].append(len(words))
            out["n_removed"].append(gone)
            out["removed"].append(spans)
            out["kept_text"].append(b" ".join(words_kept))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            [
                pa.array(out["doc_id"], pa.int64()),
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["removed"], span),
                pa.array(out["kept_text"], pa.binary()).cast(pa.string()),
            ],
            names=list(out),
        )

    return run


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window that also starts in a row of smaller id.

    Returns a row for each row of ``docs``: doc_id, n_words, n_removed, the
    maximal intervals ``removed`` (word positions, end exclusive) and
    ``kept_text`` (kept words joined by one space).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = chunk_count(total, shuffle_partitions(spark))
    tasks = min(n, MOST_TASKS)
    key = F.xxhash64("doc_id", "text", F.spark_partition_id())
    dealt = rows.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")).repartition(tasks, "chunk")
    parts = dealt.groupBy("chunk").applyInArrow(
        _reduce_chunk(width, n), "bucket int, chunk int, n int, hashes binary, owners binary, ids binary, nulls binary"
    )
    told = parts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count_bucket, "chunk int, hashes binary")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut_chunk(width), OUT)
