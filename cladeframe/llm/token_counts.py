"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
over them.  A document's state is a segment tree: leaves of ``LEAF`` pre-tokens
with their start and token count, inner nodes with the sums below them.  An edit
re-encodes from one leaf before the touched ones (the boundary context, beyond
the reach of the pattern's lookahead) to the first leaf start at which the new
split meets the old one, and updates the sums on the paths above those leaves.

State and edits are columns of the document's row, so both building and editing
are narrow passes.  The vocabulary is read once by the driver and broadcast; its
size is fixed by the tokenizer.

Rows: a null text has no tokens, and edits insert into an empty one; null edits
are none; columns named tree and n_encoded are replaced; edits refer to the text before any of them, are applied in order of
place, are clipped to the text and to the next edit's place; extra columns are
passed on.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cladeframe.functions.storage import spread
from cladeframe.llm.words import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
TREE = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("sums", T.ArrayType(T.IntegerType()))])
EDITS = "array<struct<at:int,removed:int,inserted:string>>"


class Counter(dict):
    """Tokens of a pre-token; remembers the frequent ones, within a fixed bound."""

    LIMIT = 1 << 16

    def __init__(self, vocabulary: bytes):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self[piece] = len(self.encoding._encode_single_piece(piece.encode("utf-8", "replace")))
        return n

    def count(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


def _sums(leaves: np.ndarray) -> np.ndarray:
    """A segment tree as a heap: node 1 is the root, leaves fill the second half."""
    m = 1 << max(0, int(len(leaves) - 1).bit_length())
    tree = np.zeros(2 * m, np.int64)
    tree[m : m + len(leaves)] = leaves
    while m > 1:
        m //= 2
        tree[m : 2 * m] = tree[2 * m : 4 * m : 2] + tree[2 * m + 1 : 4 * m : 2]
    return tree


def build_tree(text: str, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(start of each leaf, segment tree of token counts)."""
    pieces = counter.split.findall(text)
    if not pieces:
        return np.zeros(1, np.int64), np.zeros(2, np.int64)
    n = counter.count(pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.arange(0, len(pieces), LEAF)
    starts = (np.cumsum(size) - size)[first]
    return starts, _sums(np.add.reduceat(n, first))


class Edited:
    """A text with its tree, to which edits are applied."""

    def __init__(self, text: str, starts: np.ndarray, sums: np.ndarray, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        self.starts = [int(x) for x in starts]
        self.sums = [int(x) for x in sums]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def _set(self, leaf: int, count: int) -> None:
        i = len(self.sums) // 2 + leaf
        change = count - self.sums[i]
        while change and i:
            self.sums[i] += change
            i //= 2

    def edit(self, at: int, removed: int, inserted: str) -> None:
        old, starts = self.text, self.starts
        end = at + removed
        self.text = new = old[:at] + inserted + old[end:]
        shift = len(inserted) - removed
        first = max(0, bisect_right(starts, at) - 2)
        first = bisect_left(starts, starts[first])  # of empty leaves the first
        begin = starts[first]
        stop = at + len(inserted)
        pieces, places, p = [], [], begin
        last = len(starts)
        for m in self.counter.split.finditer(new, begin):
            p = m.start()
            if p >= stop and p > begin:
                k = bisect_left(starts, p - shift)
                if k < len(starts) and starts[k] == p - shift and p - shift >= end and k > first:
                    last = k
                    break
            pieces.append(m[0])
            places.append(p)
        self.encoded += len(pieces)
        counts = self.counter.count(pieces)
        leaves = last - first
        after = [s + shift for s in starts[last:]]
        if pieces and -(-len(pieces) // leaves) > 4 * LEAF:  # too full: more leaves, so the tree is laid out anew
            cut = list(range(0, len(pieces), LEAF))
            half = len(self.sums) // 2
            own = [int(x) for x in np.add.reduceat(counts, cut)]
            kept = self.sums[half : half + first], self.sums[half + last : half + len(starts)]
            self.starts = starts[:first] + [places[c] for c in cut] + after
            self.sums = [int(x) for x in _sums(np.array([*kept[0], *own, *kept[1]], np.int64))]
            return
        cut = [len(pieces) * i // leaves for i in range(leaves + 1)]
        edge = after[0] if after else len(new)
        self.starts = starts[:first] + [places[c] if c < len(places) else edge for c in cut[:-1]] + after
        if first == 0:
            self.starts[0] = 0
        for i in range(leaves):
            self._set(first + i, int(counts[cut[i] : cut[i + 1]].sum()))


def _clip(edits: list, size: int) -> list[tuple[int, int, str]]:
    out, limit = [], size
    for e in sorted(edits or [], key=lambda e: e["at"] or 0, reverse=True):
        at = min(max(0, e["at"] or 0), size)
        out.append((at, max(0, min(e["removed"] or 0, limit - at)), e["inserted"] or ""))
        limit = at
    return out


_counters: dict[int, Counter] = {}


def _counter(known) -> Counter:
    data = known.value
    key = hash(data)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(data)
    return _counters[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def with_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the column ``tree``; ``tree.sums[1]`` is the number of tokens."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("tree")
    known = _vocabulary(docs, vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField("tree", TREE)])
    kind = pa.struct([("starts", pa.list_(pa.int32())), ("sums", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(known)
        for b in batches:
            trees = [build_tree(t or "", counter) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            trees = pa.array([{"starts": s, "sums": t} for s, t in trees], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, trees], names=[*b.schema.names, "tree"])

    return spread(docs).mapInArrow(run, schema)


def apply_edits(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """Apply the edits of each row to its text and its tree.

    Returns the columns of ``docs`` but the edits, text and tree brought up to
    date, and ``n_encoded``, the number of pre-tokens encoded again.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_encoded")
    known = _vocabulary(docs, vocabulary)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != edits_col), T.StructField("n_encoded", T.LongType())])
    kind = pa.struct([("starts", pa.list_(pa.int32())), ("sums", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(known)
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731,B023
            tree = col("tree")
            texts, trees, encoded = [], [], []
            for text, starts, sums, edits in zip(col(text_col).to_pylist(), tree.field("starts").to_pylist(), tree.field("sums").to_pylist(), col(edits_col).to_pylist()):
                state = Edited(text or "", starts, sums, counter)
                for e in _clip(edits, len(state.text)):
                    state.edit(*e)
                texts.append(text if text is None and not edits else state.text)
                trees.append({"starts": state.starts, "sums": state.sums})
                encoded.append(state.encoded)
            new = {text_col: pa.array(texts, pa.string()), "tree": pa.array(trees, kind)}
            names = [n for n in b.schema.names if n != edits_col]
            yield pa.RecordBatch.from_arrays([*(new.get(n, col(n)) for n in names), pa.array(encoded, pa.int64())], names=[*names, "n_encoded"])

    return docs.mapInArrow(run, schema)
