"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both tokenizers break before a space that follows a character other than white
space: no token of theirs goes on there, and what stands on either side is
tokenized alike alone.  So a text is cut there into segments, each distinct
segment is tokenized and aligned once, weighted by its number, and a text's
figures are the sums over its segments.

The alignment is relational: tokens are exploded with their places, a window sums
their lengths up to each one's end, tokens of both sides meet where segment and
end are equal.  Ends of both are cuts, and their running count numbers the groups.
Every end closes a piece of text that lies in one token of either side, so each
end is one link, of the next token to end on either side; links need no pairs of
tokens to be tried.

Texts are turned into numbers of segments chunk by chunk, a chunk being some
megabytes of a task's texts with a list of its distinct segments; what travels is
a row for each chunk and segment, and each text once as numbers.

Rows: null and empty texts, and texts that a tokenizer doesn't give back byte by
byte (it normalizes, or uses a character of theirs as a space), have no tokens;
repeated rows and null ids are rows like others; a text without spaces is one
segment, however long; an empty table gives an empty one; of other columns only
the id is kept.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions.storage import materialize, spread
from cladeframe.llm.vocabularies import broadcast_vocabulary, vocabulary_path
from cladeframe.llm.words import as_bytes, bound_batches

#: A chunk ends with the text that brings it to so many places, distinct segments or bytes of them.
PLACES, SEGMENTS, BYTES = 1 << 23, 1 << 20, 1 << 25
#: Id pairs that are sent to all tasks, some tens of megabytes; beyond, they are joined by an exchange.
BROADCAST = 1_000_000
#: Segments of a row of a chunk's list.
ROW = 1 << 15
#: Before a space after a character that no version of Unicode counts as white space.
CUT = re.compile(r"(?<=[^\s᠎])(?= )")

NAMES = ["k1", "k2"]
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class ByteLevel:
    """Tokens of a byte-level BPE file, and their bytes."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from cladeframe.llm.bpe_automaton import _byte_names

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        value = _byte_names()[1]
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int32)
        for label, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(bytes(map(value.__getitem__, label)))

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces:
    """Tokens of a sentence-piece model that adds a space, and their bytes."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        self.sizes = np.zeros(self.model.vocab_size(), np.int32)
        for i in range(len(self.sizes)):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.sizes[i] = 1
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                if re.search("[^▁]▁", piece):
                    raise ValueError(f"a piece goes on over a space: {piece!r}")
                self.sizes[i] = len(piece.replace("▁", " ").encode())

    def encode(self, segments: list[str]) -> list[list[int]]:
        lone = [self.model.piece_to_id("▁")]  # the model adds no space to an empty text
        return [ids or lone for ids in self.model.encode([s[1:] for s in segments], num_threads=1)]

    def faithful(self, text: str) -> bool:
        """Whether the bytes of the tokens are those of a space and the text."""
        return "▁" not in text and self.model.normalize(text) == "▁" + text.replace(" ", "▁")


_loaded: dict[tuple, object] = {}


def _load(kind: type, known):
    key = kind, hash(known.value)
    if key not in _loaded:
        _loaded[key] = _checked(kind(known.value))
    return _loaded[key]


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers compressed, their first bytes together, then their second ones, and so on."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 4)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _places_packed(own: np.ndarray, known: int) -> bytes:
    """Numbers of a text's segments, of which the list had ``known`` before; new ones, which follow in order, as zeros."""
    return _packed(np.concatenate([[known], _again(own, known)]).astype(np.int32))


def _again(own: np.ndarray, known: int) -> np.ndarray:
    """0 for a new number's first place, for later ones the number and one."""
    most = np.maximum.accumulate(own)
    first = own > np.concatenate([[known - 1], np.maximum(most[:-1], known - 1)])
    return np.where(first, 0, own + 1)


def _places_unpacked(data: bytes) -> np.ndarray:
    told = _unpacked(data)
    own = told[1:] - 1
    new = own < 0
    own[new] = told[0] + np.arange(np.count_nonzero(new), dtype=np.int32)
    return own


def _checked(model):
    if model.sizes.max(initial=0) > 255 or len(model.sizes) > 65534:
        raise ValueError("a token of more than 255 bytes, or more than 65,534 tokens")
    return model


class _Numbers(dict):
    """Numbers of distinct keys by their first place."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _chunks(docs: DataFrame, known_b, id_type: T.DataType, most: int) -> DataFrame:
    """Rows of texts (chunk, id, places) and of segments (chunk, base, words, counts), in one table.

    places are the numbers of a text's segments in the chunk's list, compressed, null without tokens.
    """
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("places", T.BinaryType()),
            T.StructField("base", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(Pieces, known_b)
        part, turn = TaskContext.get().partitionId(), 0
        numbers, total, counts, n_bytes = _Numbers(), 0, [], 0

        def rows(ids, places) -> pa.RecordBatch:
            n = len(ids)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | turn] * n, pa.int64()), ids, pa.array(places, pa.binary()), *none], names=schema.names)

        def listed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            times = np.bincount(np.concatenate(counts), minlength=len(words)).astype(np.int32) if counts else np.empty(0, np.int32)
            for at in range(0, len(words), ROW):
                w = [x.encode("utf-8", "replace").decode() for x in words[at : at + ROW]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | turn], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), pa.array([w], pa.list_(pa.string())), pa.array([times[at : at + ROW]], pa.list_(pa.int32()))],
                    names=schema.names,
                )

        kind = pa.null()
        for b in batches:
            ids, texts, kind = b.column(0), as_bytes(b.column(1)), b.column(0).type
            first, places = 0, []
            for i, t in enumerate(texts):
                text = t.decode("utf-8", "replace") if t else ""
                if not text or not model.faithful(text):
                    places.append(None)
                    continue
                before = len(numbers)
                own = list(map(numbers.__getitem__, CUT.split(" " + text)))
                own = np.array(own, np.int32)
                places.append(_places_packed(own, before))
                counts.append(own)
                total += len(own)
                n_bytes += len(t) if len(numbers) > before else 0
                if total >= most or len(numbers) >= SEGMENTS or n_bytes >= BYTES and len(numbers) >= SEGMENTS // 4:
                    yield rows(ids.slice(first, i + 1 - first), places)
                    yield from listed(kind)
                    first, places, turn = i + 1, [], turn + 1
                    numbers, total, counts, n_bytes = _Numbers(), 0, [], 0
            if first < len(texts):
                yield rows(ids.slice(first), places)
        if numbers:
            yield from listed(kind)

    return materialize(spread(docs).mapInArrow(run, schema), "alignment-chunks", codec="zstd")


def _names(word: Column) -> list[Column]:
    """Two hashes of a segment, 96 bits together: of 10^10 segments two meet with a chance below 10^-9."""
    return [F.xxhash64(word).alias("k1"), F.shiftright(F.xxhash64(F.lit("second"), word), 32).cast("int").alias("k2")]


def tokenized(segments: DataFrame, known_a, known_b) -> DataFrame:
    """``segments`` without ``word``, with ``tokens``: id * 256 + size of the first tokenizer's tokens, ``n_first`` of them, then of the second's."""

    @F.arrow_udf("struct<n_first:int,tokens:array<int>>")
    def both(words: pa.Array) -> pa.Array:
        words = words.to_pylist()
        models = [_load(ByteLevel, known_a), _load(Pieces, known_b)]
        sides = [m.encode(words) for m in models]
        n = [np.fromiter(map(len, ids), np.int64, len(words)) for ids in sides]
        ends = np.concatenate([[0], np.cumsum(n[0] + n[1])])
        packed = np.empty(int(ends[-1]), np.int32)
        for k, (m, found) in enumerate(zip(models, sides)):
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(n[k].sum()))
            first = ends[:-1] + (n[0] if k else 0)
            packed[np.arange(len(flat)) + np.repeat(first - (np.cumsum(n[k]) - n[k]), n[k])] = flat << 8 | m.sizes[flat]
        tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(packed))
        return pa.StructArray.from_arrays([pa.array(n[0].astype(np.int32)), tokens], names=["n_first", "tokens"])

    # told to be nondeterministic, so that it runs once, and not before repeats are put together
    return segments.withColumn("t", both.asNondeterministic()("word")).select(*(c for c in segments.columns if c != "word"), "t.n_first", "t.tokens")


def links(tokens: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """(key, keep, end, a, b, own_a, own_b, grp): a row for each end of a token of either side.

    a, b: the linked tokens; own_a, own_b: those that end here, null if none does; a
    row with both is a cut; grp: cuts from here on, the number of the group counted
    from the last one.  ``tokens`` has side, place, id and size, a row a token, and
    ``keep`` depends on the key alone; no size is 0.  If it is dealt by the key, nothing is shuffled.
    """
    so_far = Window.partitionBy(*key, *keep, "side").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = tokens.withColumn("end", F.sum("size").over(so_far))
    met = ended.groupBy(*key, *keep, "end").agg(F.max(F.when(F.col("side") == 0, F.col("id"))).alias("own_a"), F.max(F.when(F.col("side") == 1, F.col("id"))).alias("own_b"))
    from_end = Window.partitionBy(*key, *keep).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("own_a").isNotNull() & F.col("own_b").isNotNull()
    return met.select(
        *key, *keep, "end", "own_a", "own_b", F.last("own_a", True).over(from_end).alias("a"), F.last("own_b", True).over(from_end).alias("b"), F.count_if(cut).over(from_end).alias("grp")
    )


def _big_endian(number: Column, digits: int) -> Column:
    """The lowest ``digits`` hexadecimal digits of a number, which no higher ones follow."""
    return F.lpad(F.hex(number), digits, "0")


def _sums(n_best: Column, count_sum: Column) -> Column:
    """What stands before the codes; words that are small for most segments stand together, so that they compress."""
    count = _big_endian(count_sum, 16)
    return F.unhex(F.concat(F.substring(count, 9, 8), F.substring(count, 1, 8), _big_endian(n_best, 8)))


def _told(packed: pa.Array) -> tuple[np.ndarray, ...]:
    """n_groups, n_best and count_sum of each segment, its codes laid end to end, and their number.

    A segment's row is 32-bit big-endian words: the low half of count_sum, the high one, n_best, n_groups, the codes.
    """
    at = np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False), dtype=np.int64)]) // 4
    words = np.frombuffer(b"".join(packed.to_pylist()), ">u4").astype(np.uint32)
    first = at[:-1]
    inner = np.ones(len(words), bool)
    for k in range(4):
        inner[first + k] = False
    wide = words.astype(np.int64)
    return wide[first + 3], wide[first + 2], wide[first + 1] << 32 | wide[first], words[inner], np.diff(at) - 4


def _rows_packed(places: np.ndarray, packed: pa.Array) -> bytes:
    """Segments' rows and their places in a chunk's list, compressed column by column."""
    order = np.argsort(places)
    packed = packed.take(pa.array(order))
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 4
    words = np.frombuffer(b"".join(packed.to_pylist()), ">u4").astype(np.uint32).view(np.int32)
    heads = (np.cumsum(sizes) - sizes)[None, :] + np.arange(4)[:, None]
    codes = np.delete(words, heads.ravel())
    return _packed(np.concatenate([[len(order)], np.diff(places[order], prepend=0), sizes, words[heads].ravel(), codes]).astype(np.int32))


def _rows_unpacked(data: bytes) -> tuple[np.ndarray, pa.Array]:
    told = _unpacked(data)
    m = int(told[0])
    sizes = told[m + 1 : 2 * m + 1]
    ends = np.cumsum(sizes, dtype=np.int64)
    heads = (ends - sizes)[None, :] + np.arange(4)[:, None]
    words, inner = np.empty(int(ends[-1]), ">u4"), np.ones(int(ends[-1]), bool)
    inner[heads] = False
    words[heads] = told[2 * m + 1 : 6 * m + 1].view(np.uint32).reshape(4, m)
    words[inner] = told[6 * m + 1 :].view(np.uint32)
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return np.cumsum(told[1 : m + 1]), pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, rows): runs of rows (of, place, packed) of one chunk, up to ``ROW`` of them in one."""
    held, of, total = [], None, 0

    def row() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        data = _rows_packed(t["place"].to_numpy(), t["packed"].cast(pa.binary()).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([data], pa.binary())], names=["of", "rows"])

    for b in batches:
        chunk = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
            if held and (of != chunk[x] or total >= ROW):
                yield row()
                held, total = [], 0
            if x < y:
                of, total = int(chunk[x]), total + y - x
                held.append(b.slice(x, y - x))
    if held:
        yield row()


def group_text(codes: list[int]) -> str:
    """`a1,a2|b1;a3|b2,b3` of the ends of a segment: (id that ends on the first side + 1) * 65536 + (that on the second + 1), 0 for none."""
    out, a, b = [], [], []
    for code in codes:
        x, y = code >> 16, code & 65535
        if x:
            a.append(str(x - 1))
        if y:
            b.append(str(y - 1))
        if x and y:
            out.append(",".join(a) + "|" + ",".join(b))
            a, b = [], []
    return ";".join(out)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None, places: int = PLACES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text.

    vocabulary_a is a byte-level BPE file, vocabulary_b a sentence-piece model that
    adds a space; both see a space and the text.  An id pair's count is the number
    of links of the corpus that hold it; n_best: links whose count is the highest of
    their b id; count_sum: over links; groups_sha256: of the groups' ids, '' without tokens.  A chunk ends
    at ``places`` segments.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known_a = broadcast_vocabulary(spark, vocabulary_a or vocabulary_path("byte_bpe_50k.json"))
    known_b = broadcast_vocabulary(spark, vocabulary_b or vocabulary_path("piece_bpe_32k.model"))
    id_type = docs.schema[id_col].dataType
    chunks = _chunks(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), known_b, id_type, places)

    lists = chunks.where("words IS NOT NULL").select("chunk", "base", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x"))
    lists = lists.select(*_names(F.col("x.words")), "chunk", (F.col("base") + F.col("i")).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    segments = lists.groupBy("word").agg(F.sum("n").alias("n")).select("word", *_names(F.col("word")), "n")
    # dealt by segment once, as lists of tokens: what follows needs no other exchange
    tokens = tokenized(segments, known_a, known_b).repartition(*NAMES).select(*NAMES, "n", "n_first", F.posexplode("tokens").alias("place", "t"))
    tokens = tokens.select(*NAMES, "n", (F.col("place") >= F.col("n_first")).cast("int").alias("side"), "place", F.shiftright("t", 8).alias("id"), F.col("t").bitwiseAND(F.lit(255)).alias("size"))
    code = F.shiftleft(F.coalesce(F.col("own_a") + 1, F.lit(0)), 16).bitwiseOR(F.coalesce(F.col("own_b") + 1, F.lit(0)))
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    ends = F.array_sort(F.collect_list(F.struct("end", code.alias("code"), pair.alias("pair"))))
    per = links(tokens, NAMES, ["n"]).groupBy(*NAMES, "n").agg(F.max("grp").alias("n_groups"), ends.alias("ends"))
    # packed, as it is sent to each chunk that holds the segment: lists and numbers of eight bytes take a third more
    codes = F.transform("ends.code", lambda c: _big_endian(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8))
    codes = F.unhex(F.concat(_big_endian(F.col("n_groups"), 8), F.array_join(codes, "")))
    per = materialize(per.select(*NAMES, "n", codes.alias("codes"), F.col("ends.pair").alias("pairs")), "alignment-segments", codec="zstd")

    pairs = per.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    pairs = materialize(pairs, "alignment-pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = pairs.groupBy(b_id).agg(F.max("count").alias("most"))
    rated = pairs.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    if pairs.count() <= BROADCAST:
        rated = F.broadcast(rated)
    # a segment's row is put together again where it was taken apart, then sent once with its sums
    rated = per.select(*NAMES, "codes", F.explode("pairs").alias("pair")).join(rated, "pair")
    rated = rated.groupBy(*NAMES).agg(F.first("codes").alias("codes"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    rated = rated.select(*NAMES, F.concat(_sums(F.col("n_best"), F.col("count_sum")), "codes").alias("packed"))
    told = lists.select(*NAMES, "chunk", "place").join(rated, NAMES).select(F.col("chunk").alias("of"), "place", "packed")
    # what a task has for a chunk travels as columns, in a third of the bytes of single rows
    told = told.sortWithinPartitions("of").mapInArrow(_gathered, "of long, rows binary")
    texts = chunks.where("words IS NULL").select("chunk", "id", "places")
    out_type = T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.LongType()) for n in FIGURES), T.StructField("groups_sha256", T.StringType())])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_rows_unpacked(x) for x in right["rows"].to_pylist()]
        order = np.argsort(np.concatenate([x for x, _ in parts] or [np.empty(0, np.int32)]))
        groups, best, count, ends, n = _told(pa.concat_arrays([x for _, x in parts] or [pa.array([], pa.binary())]).take(pa.array(order)))
        starts = np.cumsum(n) - n
        per = [np.add.reduceat((x != 0).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64) for x in (ends >> 16, ends & 65535)]
        figures = np.stack([*per, groups, n, best, count])
        text, stops = ends.tolist(), np.cumsum(n).tolist()
        groups = [group_text(text[z - k : z]) for z, k in zip(stops, n.tolist())]
        ids, places = left["id"].combine_chunks(), left["places"].combine_chunks()
        found = np.zeros((len(FIGURES), len(ids)), np.int64)
        hashes = [""] * len(ids)
        for i, p in enumerate(places):
            if p.is_valid:
                own = _places_unpacked(p.as_py())
                found[:, i] = figures[:, own].sum(axis=1)
                hashes[i] = hashlib.sha256(";".join(map(groups.__getitem__, own.tolist())).encode()).hexdigest()
        return pa.table([ids, *map(pa.array, found), pa.array(hashes, pa.string())], names=out_type.names)

    out = texts.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(assemble, out_type)
    return out.withColumnRenamed("id", id_col)
