"""Edges between the neighbours of a node, looked up cell by cell.

Nodes are dealt to blocks by a hash, and a cell holds the edges between two
blocks.  A node's list of neighbours goes to a cell as its members in the two
blocks, so each neighbour is sent once a block and no pair is sent at all; the
pairs are made where the cell's edges are, some thousand lists at a time.
There are as many cells as keep one to ``CELL`` edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.kmers import _narrow, _wide

#: Edges of a cell, the least number of blocks, lists of a record, edges of a record.
CELL, BLOCKS, LISTS, EDGES = 1 << 21, 6, 1000, 1 << 18
#: kind: 0 for edges (ids, others), 1 for lists (nodes, and for either block sizes and ids).
RECORD = "cell int, kind int, n int, m int, nodes binary, ids binary, others binary, sizes binary, other_sizes binary"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
KINDS = [pa.int32()] * 4 + [pa.binary()] * 5


def block_count(n_edges: int) -> int:
    return max(BLOCKS, ceil(sqrt(2 * n_edges / CELL)))


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(blocks)).astype(np.int64)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=COLUMNS)


def _longs(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(column), np.int64)


def _pack_edges(blocks: int):
    """Edges as records of their cells."""

    def flush(held: list) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        x, y = _block(u, blocks), _block(v, blocks)
        cell = np.minimum(x, y) * blocks + np.maximum(x, y)
        order = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
        return _records([(int(cell[o[0]]), 0, len(o), 0, None, _narrow(u[o]), _narrow(v[o]), None, None) for o in np.split(order, begin[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((_longs(b.column(0)), _longs(b.column(1))))
                n += b.num_rows
            if n >= EDGES:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _pack_lists(blocks: int):
    """Lists of neighbours as records of the cells of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LISTS):
                b = whole.slice(at, LISTS)
                lists = b.column(1)
                ids, nodes = _longs(lists.flatten()), _narrow(_longs(b.column(0)))
                owner = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                block = _block(ids, blocks)
                own = []
                for k in range(blocks):
                    some = block == k
                    own.append((int(some.sum()), _narrow(ids[some]), np.bincount(owner[some], minlength=b.num_rows).astype(np.uint32).tobytes()))
                rows = []
                for i, (n, x, sizes) in enumerate(own):
                    for j in range(i, blocks):
                        m, y, other = own[j] if j > i else (0, None, None)
                        if n > 1 if j == i else n and m:
                            rows.append((i * blocks + j, 1, n, m, nodes, x, y, sizes, other))
                if rows:
                    yield _records(rows)

    return run


class _Cell:
    """Edges of a cell: its nodes in order, and pairs of their places.

    A table of marks by a hash rules most pairs out before they are looked up.
    """

    def __init__(self, edges: list[tuple]):
        u, v = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (zip(*edges) if edges else ((), ())))
        self.nodes = np.unique(np.r_[u, v])
        self.keys = np.sort(np.searchsorted(self.nodes, u) << 32 | np.searchsorted(self.nodes, v))
        self.shift = np.uint64(64 - max(10, (8 * len(u)).bit_length()))
        self.marks = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.marks[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def places(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, place) of the ids that have edges here."""
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        some = self.nodes[at] == ids
        return np.repeat(np.arange(len(sizes)), sizes)[some], at[some]

    def count(self, n_lists: int, one: tuple, two: tuple | None) -> np.ndarray:
        """For each list how many pairs of its members, one of either side or both of the only one, are edges."""
        if not len(self.keys):
            return np.zeros(n_lists, np.int64)
        owner, x = self.places(*one)
        others, y = self.places(*two) if two else (owner, x)
        sizes = np.bincount(others, minlength=n_lists)
        times = sizes[owner]
        ends = np.cumsum(times)
        turn = np.arange(int(times.sum())) - np.repeat(ends - times, times)
        b = y[np.repeat((np.cumsum(sizes) - sizes)[owner], times) + turn]
        a = np.repeat(x, times)
        keys = np.minimum(a, b) << 32 | np.maximum(a, b)
        maybe = self.marks[self._slot(keys)]
        if not two:
            maybe &= a < b
        maybe = np.flatnonzero(maybe)
        keys = keys[maybe]
        hit = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        return np.bincount(np.repeat(owner, times)[maybe[hit]], minlength=n_lists)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, found) of the lists of each cell, whose edges come before them."""
    now, edges, cell = None, [], None
    for b in batches:
        ids, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in range(b.num_rows):
            name, kind, n, m, nodes, one, two, sizes, others = (b.column(i)[r] for i in range(9))
            wide = lambda x, k: _wide(x.as_buffer(), k).view(np.int64)
            name, n, m = name.as_py(), n.as_py(), m.as_py()
            if name != now:
                now, edges, cell = name, [], None
            if kind.as_py() == 0:
                edges.append((wide(one, n), wide(two, n)))
                continue
            if cell is None:
                cell, edges = _Cell(edges), []
            sizes = np.frombuffer(sizes.as_buffer(), np.uint32)
            other = (wide(two, m), np.frombuffer(others.as_buffer(), np.uint32)) if m else None
            got = cell.count(len(sizes), (wide(one, n), sizes), other)
            some = np.flatnonzero(got)
            ids.append(wide(nodes, len(sizes))[some])
            found.append(got[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], names=["id", "found"])


def pairs_with_edge(lists: DataFrame, edges: DataFrame, n_edges: int) -> DataFrame:
    """(id, found): how many pairs of the members of each list (id, near) are edges; lists without one are left out.

    ``edges`` (src, dst) has each edge once with src below dst, ``n_edges`` of
    them; members are distinct, and a list is small.
    """
    blocks = block_count(n_edges)
    records = edges.select("src", "dst").mapInArrow(_pack_edges(blocks), RECORD).unionByName(lists.select("id", "near").mapInArrow(_pack_lists(blocks), RECORD))
    dealt = records.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_tally, "id long, found long").groupBy("id").agg(F.sum("found").alias("found"))
