"""Query-anchored alignments from search hits, with gap trimming.

A target's row is never laid out cell by cell for counting.  Its letters are
intervals of the query's columns, from the runs of its segments; where segments of
one target overlap the last one holds.  How many rows have a letter in a column is
a running sum over the ends of intervals, so a query's columns fall into few
intervals of equal gaps; those with few enough gaps, up to the first 4,988 columns,
cut the rows.  Hits are dealt by query, and stay where they are if they are dealt
so already; a query's columns are found and its rows cut in one pass, of which a
few bytes a row are sent to the targets' sequences.  Rows of a query are never
gathered: those of a query with very many wait in a file of the task.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_COLUMNS = 4988
PAIR = ["query", "target"]


PARTS = "parts array<struct<c:int,e:int,t:int>>"
#: Rows that a task holds to cut them; those of a query with more wait in a file.
HELD = 1 << 15


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items repeated ``counts`` times: which item each copy is of, and its number among them."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def cigar_runs(cigar: str | None) -> list[tuple[int, int, int]]:
    """(c, t, n) of a path's matches: columns and letters from its start, and how many."""
    c = t = 0
    out = []
    for n, op in re.findall(r"(\d+)([A-Z])", cigar or ""):
        n = int(n)
        if op == "M":
            out.append((c, t, n))
        c += n if op in "MI" else 0
        t += n if op in "MD" else 0
    return out


def _letters(t: pa.Table, *more: str) -> pa.RecordBatch:
    """(query, target, parts, what else a pair's segments tell alike) of whole pairs, whose segments stand together in order: what no later segment covers."""
    query, target = (np.asarray(t.column(c)) for c in PAIR)
    first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (target[1:] != target[:-1])])
    pair = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(query)]))
    told = np.ones(len(query), bool)
    for c in ("qstart", "qend", "sstart", "cigar"):
        told &= np.asarray(t.column(c).combine_chunks().is_valid())
    kept = np.flatnonzero(told)
    pair = pair[kept]
    qstart, stop, sstart = (np.asarray(t.column(c).fill_null(0)).astype(np.int64)[kept] for c in ("qstart", "qend", "sstart"))
    stop = stop + 1
    codes = t.column("cigar").combine_chunks().dictionary_encode()
    paths = [np.array(cigar_runs(x), np.int64).reshape(-1, 3) for x in codes.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in paths], np.int64)
    runs = np.concatenate([*paths, np.empty((0, 3), np.int64)])
    code = np.asarray(codes.indices.fill_null(0))[kept]
    # All ends of a pair's segments cut its columns into pieces; a piece is the last segment's that covers it.
    at, of = np.r_[qstart, stop], np.r_[pair, pair]
    by = np.lexsort((at, of))
    at, of = at[by], of[by]
    piece = np.flatnonzero((of[1:] == of[:-1]) & (at[1:] > at[:-1]))
    begin, end, of = at[piece], at[piece + 1], of[piece]
    count = np.bincount(pair, minlength=len(first))
    i, k = _spread(count[of])
    seg = (np.cumsum(count) - count)[of][i] + k
    over = (qstart[seg] <= begin[i]) & (stop[seg] >= end[i])
    last = np.full(len(piece), -1)
    last[i[over]] = seg[over]  # of equal places the last one stays
    seen = np.flatnonzero(last >= 0)
    begin, end, of, seg = begin[seen], end[seen], of[seen], last[seen]
    i, k = _spread(sizes[code[seg]])
    r = runs[(np.cumsum(sizes) - sizes)[code[seg]][i] + k]
    from_ = qstart[seg][i] + r[:, 0]
    c, e = np.maximum(from_, begin[i]), np.minimum(from_ + r[:, 2], end[i])
    some = (c < e) & (c > 0)
    c, e, of, letter = c[some], e[some], of[i][some], (sstart[seg][i] + r[:, 1] + c - from_)[some]
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(first)))].astype(np.int32))
    parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (c, e, letter)], names=["c", "e", "t"])
    own = t.select([*PAIR, *more]).take(pa.array(first)).combine_chunks()
    query, target, *rest = (c.chunk(0) for c in own.columns)
    return pa.RecordBatch.from_arrays([query, target, pa.ListArray.from_arrays(offsets, parts), *rest], names=[*PAIR, "parts", *more])


def _dealt(hits: DataFrame, *more: str) -> DataFrame:
    """Segments by query, a pair's together in order; no exchange if they are dealt by query."""
    own = hits.where("query IS NOT NULL AND target IS NOT NULL").select(
        *(F.col(c).cast("long") for c in PAIR), *(F.col(c).cast("int") for c in ("qstart", "qend", "sstart")), "cigar", "ord", *more
    )
    number = F.row_number().over(Window.partitionBy("query").orderBy("target", "ord"))
    return own.withColumn("number", number).drop("ord")


def _pairs(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[pa.RecordBatch]:
    """Letters of whole pairs; the last pair of a batch waits for the next batch."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        query, target = (np.asarray(t.column(c)) for c in PAIR)
        own = np.flatnonzero((query != query[-1]) | (target != target[-1]))
        cut = own[-1] + 1 if len(own) else 0
        if cut:
            yield _letters(t.slice(0, cut), *more)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield _letters(rest, *more)


def letters(hits: DataFrame) -> DataFrame:
    """(query, target, parts) for each pair: columns [c, e) of the query in which the target's row has letters, the first at t.

    ``hits`` are segments (query, target, qstart, qend, sstart, cigar, ord); what a
    path has beyond its segment's end isn't seen.
    """
    return _dealt(hits).mapInArrow(_pairs, "query long, target long, " + PARTS)


def gap_intervals(intervals: DataFrame, sizes: DataFrame, max_gap: float = 0.7) -> DataFrame:
    """(query, begin, stop, gaps, rows, good): columns [begin, stop) with equal numbers of gaps.

    ``intervals`` is (query, c, e), letters of any row; ``sizes`` is (query, width,
    rows).  Ends are summed where they are read.
    """
    ends = intervals.select("query", F.explode(F.array(F.struct(F.col("c").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("query", "x.*")
    edges = sizes.select("query", F.explode(F.array(F.lit(1), F.col("width") + 1)).alias("at"), F.lit(0).alias("d"))
    steps = ends.unionByName(edges).groupBy("query", "at").agg(F.sum("d").alias("d"))
    so_far = Window.partitionBy("query").orderBy("at")
    spans = steps.select("query", F.col("at").alias("begin"), F.lead("at").over(so_far).alias("stop"), F.sum("d").over(so_far).alias("filled"))
    spans = spans.join(sizes, "query").select("query", F.greatest("begin", F.lit(1)).alias("begin"), F.least("stop", F.col("width") + 1).alias("stop"), (F.col("rows") - F.col("filled")).alias("gaps"), "rows")
    return spans.where("begin < stop").withColumn("good", F.col("gaps") / F.col("rows") < max_gap)


def first_columns(spans: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """(query, good): the good intervals of each query in order, as array<struct<begin,size>>, cut to ``most`` columns together."""
    size = F.col("stop") - F.col("begin")
    before = Window.partitionBy("query").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    good = spans.where("good").select("query", "begin", size.alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    kept = good.where(F.col("before") < most).select("query", "begin", F.least("size", F.lit(most) - F.col("before")).cast("int").alias("size"))
    return kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("begin", "size"))).alias("good"))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The row of each part, and its c, e and t."""
    parts = b.column(2)
    x = parts.flatten()
    return np.repeat(np.arange(len(parts)), np.diff(np.asarray(parts.offsets))), *(np.asarray(x.field(k)).astype(np.int64) for k in range(3))


def _summed(of: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``d`` by (of, at), in their order."""
    by = np.lexsort((at, of))
    of, at, d = of[by], at[by], d[by]
    begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])]) if len(of) else np.empty(0, np.int64)
    return of[begin], at[begin], np.add.reduceat(d, begin) if len(begin) else d


def _good(ends: tuple[np.ndarray, ...], rows: np.ndarray, own: np.ndarray, width: np.ndarray, max_gap: float, most: int) -> tuple[np.ndarray, ...]:
    """(of, begin, size, before): good columns of each query in order, as intervals, and how many good ones are before them.

    ``ends`` are (of, at, d), sums of the rows' letters that begin or end at a column;
    a query without a row of its own has one more, of letters all over.  As in
    :func:`gap_intervals` and :func:`first_columns`, which are for tables.
    """
    of, at, d = ends
    all_ = np.arange(len(rows))
    alone = (~own).astype(np.int64)
    of, at, d = _summed(np.r_[of, all_, all_], np.r_[at, np.ones_like(width), width + 1], np.r_[d, alone, -alone])
    filled = np.cumsum(d)  # a query's ends add to zero
    begin, stop = np.maximum(at[:-1], 1), np.minimum(at[1:], width[of[:-1]] + 1)
    total = (rows + alone)[of[:-1]]
    good = (of[1:] == of[:-1]) & (begin < stop) & ((total - filled[:-1]) / total < max_gap)
    of, begin, size = of[:-1][good], begin[good], (stop - begin)[good]
    if not len(of):
        return of, begin, size, size
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (begin[1:] != (begin + size)[:-1])])
    of, begin, size = of[first], begin[first], np.add.reduceat(size, first)
    before = np.cumsum(size) - size
    before -= before[np.searchsorted(of, of)]
    kept = before < most
    return of[kept], begin[kept], np.minimum(size, most - before)[kept], before[kept]


def _pack(row: np.ndarray, numbers: np.ndarray, n: int) -> pa.Array:
    """Each row's numbers, as a byte that tells how many bytes one takes, and those bytes."""
    width = np.ones(n, np.int64)
    numbers = numbers.astype("<u4")
    largest = numbers.max(axis=1)
    for bytes_, least in ((2, 1 << 8), (4, 1 << 16)):
        width[row[largest >= least]] = np.maximum(width[row[largest >= least]], bytes_)
    sizes = 1 + numbers.shape[1] * np.bincount(row, minlength=n) * width
    offsets = np.r_[0, np.cumsum(sizes)]
    out = np.empty(offsets[-1], np.uint8)
    head = np.zeros(len(out), bool)
    head[offsets[:-1]] = True
    out[head] = width
    each = numbers.view(np.uint8).reshape(-1, 4)
    out[~head] = each[np.arange(4) < np.repeat(width[row], numbers.shape[1])[:, None]]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _unpack(packed: pa.Array, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each group of numbers, and the numbers."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1].astype(np.int64)
    bytes_ = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    width = bytes_[offsets[:-1]].astype(np.int64)
    count = (np.diff(offsets) - 1) // (width * columns)
    row = np.repeat(np.arange(len(packed)), count)
    head = np.zeros(len(bytes_), bool)
    head[offsets[:-1]] = True
    each = np.zeros((len(row) * columns, 4), np.uint8)
    each[np.arange(4) < np.repeat(width[row], columns)[:, None]] = bytes_[~head]
    return row, each.view("<u4").reshape(-1, columns).astype(np.int64)


CUT = ("query", "target", "size", "cut")


def _cut(query: np.ndarray, target: np.ndarray, which: np.ndarray, flat: tuple[np.ndarray, ...], good: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """(query, target, size, cut) of the rows whose query, the ``which``-th, has a good column: the row's length, and where in it which letters are."""
    of, begin, size, before = good
    n = np.bincount(of, minlength=which.max(initial=-1) + 1)
    at = np.cumsum(n) - n
    whole = np.bincount(of, size, minlength=len(n)).astype(np.int32)[which]
    row, c, e, t = flat
    i, k = _spread(n[which[row]])
    j = at[which[row]][i] + k
    a, b = np.maximum(c[i], begin[j]), np.minimum(e[i], begin[j] + size[j])
    some = a < b
    i, j, a, b = i[some], j[some], a[some], b[some]
    kept = np.flatnonzero(whole)
    numbers = np.stack([before[j] + a - begin[j], b - a, t[i] + a - c[i]], axis=1)
    packed = _pack((np.cumsum(whole > 0) - 1)[row[i]], numbers, len(kept))
    return pa.RecordBatch.from_arrays([pa.array(query[kept]), pa.array(target[kept]), pa.array(whole[kept]), packed], names=CUT)


def _ends(which: np.ndarray, flat: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    row, c, e, _ = flat
    one = np.ones(len(c), np.int64)
    return _summed(np.r_[which[row], which[row]], np.r_[c, e], np.r_[one, -one])


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(b.column(k)).astype(np.int64) for k in (0, 1, 3))


def _whole(query: np.ndarray, own: np.ndarray, good: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """The rows of queries without a hit on themselves."""
    alone = np.flatnonzero(~own)
    of, begin, size, _ = good
    row = np.searchsorted(alone, of)
    at = np.flatnonzero(np.isin(of, alone))
    return _cut(query[alone], query[alone], alone, (row[at], begin[at], (begin + size)[at], begin[at]), good)


def _queries(pairs: Iterator[pa.RecordBatch], max_gap: float, most: int) -> Iterator[pa.RecordBatch]:
    """Cut rows of (query, target, parts, width), a query's together."""

    def many(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries that are held whole."""
        b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        query, target, width = _columns(b)
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rows = np.diff(np.r_[first, len(query)])
        which = np.repeat(np.arange(len(first)), rows)
        own, flat = np.logical_or.reduceat(query == target, first), _flat(b)
        good = _good(_ends(which, flat), rows, own, width[first], max_gap, most)
        yield _cut(query, target, which, flat, good)
        yield _whole(query[first], own, good)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query of any number of rows, which wait in a file."""
        ends, rows, own = (np.empty(0, np.int64),) * 3, 0, False
        with tempfile.TemporaryFile() as f:
            writer = None
            for b in batches:
                query, target, width = _columns(b)
                new = _ends(np.zeros(len(query), np.int64), _flat(b))
                ends = _summed(*(np.r_[x, y] for x, y in zip(ends, new)))
                rows, own = rows + len(query), own | (query == target).any()
                writer = writer or pa.ipc.new_stream(f, b.schema)
                writer.write_batch(b)
            writer.close()
            f.seek(0)
            good = _good(ends, np.array([rows]), np.array([own]), width[:1], max_gap, most)
            for b in pa.ipc.open_stream(f):
                query, target, _ = _columns(b)
                yield _cut(query, target, np.zeros(len(query), np.int64), _flat(b), good)
            yield _whole(query[:1], np.array([own]), good)

    held: list[pa.RecordBatch] = []  # whole queries, and the last that may go on
    n = 0
    pairs = (b for b in pairs if b.num_rows)
    last = lambda b: b.column(0)[b.num_rows - 1].as_py()
    for b in pairs:
        held.append(b)
        n += b.num_rows
        if n <= HELD:
            continue
        going = last(b)
        before = []
        while held and last(held[-1]) == going:  # all of the last query's rows
            x = held.pop()
            cut = int(np.searchsorted(np.asarray(x.column(0)) == going, True))
            before.insert(0, x.slice(cut))
            if cut:
                held.append(x.slice(0, cut))
                break
        if held:
            yield from many(held)
        held, n = before, sum(x.num_rows for x in before)
        if n > HELD:
            rest: list[pa.RecordBatch] = []

            def its() -> Iterator[pa.RecordBatch]:
                yield from before
                for x in pairs:
                    same = np.asarray(x.column(0)) == going
                    size = len(same) if same.all() else int(np.argmin(same))
                    if size:
                        yield x.slice(0, size)
                    if size < len(same):
                        rest.append(x.slice(size))
                        return

            yield from one(its())
            held, n = rest, sum(x.num_rows for x in rest)
    if held:
        yield from many(held)


def _rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """(query, target, row): each target's letters in the good columns of its query, gaps elsewhere."""
    names = b.schema.names
    column = lambda c: b.column(names.index(c))
    seqs = column("seq").to_pylist()
    code = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    size = np.array([len(x) for x in seqs], np.int64)
    width = np.asarray(column("size")).astype(np.int64)
    begin, ends = np.cumsum(size) - size, np.cumsum(width)
    cells = np.full(int(width.sum()), ord("-"), np.uint32)
    row, cut = _unpack(column("cut"), 3)
    i, k = _spread(cut[:, 1])
    letter = cut[i, 2] - 1 + k
    some = (letter >= 0) & (letter < size[row[i]])
    i, k, letter = i[some], k[some], letter[some]
    cells[(ends - width)[row[i]] + cut[i, 0] + k] = code[begin[row[i]] + letter]
    whole = cells.tobytes().decode("utf-32-le")
    ends = [0, *ends.tolist()]
    return pa.RecordBatch.from_arrays([column("query"), column("target"), pa.array([whole[x:y] for x, y in zip(ends, ends[1:])], pa.string())], names=[*PAIR, "row"])


def alignments(hits: DataFrame, protein: DataFrame, max_gap: float = 0.7, most: int = MOST_COLUMNS, known: bool = False) -> DataFrame:
    """(query, target, row) for each query with a good column, in its first ``most`` good columns.

    ``hits`` are segments (query, target, qstart, qend, sstart, cigar, ord).  A
    query without a hit on itself stands with its whole sequence; a hit without a
    letter is a row of gaps; queries and targets that aren't in ``protein`` go.
    With ``known`` all targets are in ``protein``, and aren't sought there first.
    """
    seqs = protein.where("seq IS NOT NULL").select(F.col("protein_id").cast("long").alias("target"), "seq")
    width = seqs.select(F.col("target").alias("query"), F.length("seq").cast("int").alias("width"))
    if not known:
        hits = hits.join(seqs.select("target"), "target", "left_semi")
    dealt = _dealt(hits.join(width.hint("shuffle_hash"), "query"), "width")
    cut = dealt.mapInArrow(lambda batches: _queries(_pairs(batches, "width"), max_gap, most), "query long, target long, size int, cut binary")
    rows = cut.join(seqs.hint("shuffle_hash"), "target").select(*CUT, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(b)

    return rows.mapInArrow(run, "query long, target long, row string")
