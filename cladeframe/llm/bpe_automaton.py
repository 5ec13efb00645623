"""BPE as a deterministic automaton over tokens.

Without merges the automaton has one state, in which every base symbol may
follow.  Merges are compiled in turn by a gadget: for the merge (x, y) the state
that x leads to is copied without its arc y, the arcs x are led to the copy, and
wherever x may follow, an arc xy is added that leads where x and then y led; a
merge whose y never comes after x adds nothing.  All
arcs of a label lead to one state, so a state is a copy of an earlier one less one
arc, plus arcs that come later.  An arc xy comes where x is an arc, so what a copy
lacks, besides y, are the tokens that grow out of y from the left after it was
made.  Numbered so that each token's later growths follow it directly, these are
an interval, and a state's table is a sorted list of such intervals.

A sequence of tokens is the encoding of its word if and only if the automaton
takes it, and every word has exactly one such sequence.  The same holds for each
prefix of the word, so encoding keeps one state a position: from each position it
follows the letters of the vocabulary and takes the arcs that the table has.
Decoding walks the ids and emits the label of each arc.

Texts are normalized and split as the tokenizer's file says.  The interpreter and
the tokenizers library know different versions of Unicode; texts with a character
on which they disagree are split by the library, all others by the interpreter,
which is faster.

Rows: null and empty texts have no tokens, and no tokens decode to the empty text;
repeated rows are encoded alike; a text of any length is encoded whole, a word in
time that grows with its length; columns named as results are replaced, others are
passed on; an empty table stays empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, normalizers

from cladeframe.functions.storage import spread
from cladeframe.llm.vocabularies import read_vocabulary, vocabulary_path
from cladeframe.llm.words import as_bytes, bound_batches


class Automaton:
    """The compiled automaton: the state each token leads to, and the arcs each state lacks."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        n = max(vocabulary.values()) + 1
        self.suffix = suffix
        self.labels = [""] * n
        for label, i in vocabulary.items():
            self.labels[i] = label
        born, left = [-1] * n, [-1] * n
        grows: list[list[int]] = [[] for _ in range(n)]  # tokens made of this one and another, by age
        self.target = [0] * n
        self.dead: set[int] = set()
        origin, lacks, since = [0], [-1], [-1]
        for k, (x, y) in enumerate(merges):
            made = x.removesuffix(suffix) + y if suffix else x + y
            if not (x in vocabulary and y in vocabulary and made in vocabulary):
                raise ValueError(f"merge {k} uses a token that the vocabulary lacks")
            a, b, c = vocabulary[x], vocabulary[y], vocabulary[made]
            if born[c] >= 0 or max(born[a], born[b]) >= k or not grows[c] == []:
                raise ValueError(f"merge {k} makes a token a second time, or after its use")
            before = self.target[a]
            born[c] = k
            if a in self.dead or b in self.dead or not self._has(before, b, left, born, origin, lacks, since):
                self.dead.add(c)  # y never comes after x, so the merge does nothing
                continue
            left[c] = a
            grows[a].append(c)
            origin.append(before)
            lacks.append(b)
            since.append(k)
            self.target[c] = before if a == b else self.target[b]
            self.target[a] = len(origin) - 1
        self._number(born, left, grows)
        self._tables(born, grows, origin, lacks, since)

    @staticmethod
    def _has(state: int, token: int, left: list[int], born: list[int], origin: list[int], lacks: list[int], since: list[int]) -> bool:
        """Whether a state has an arc while the gadgets are being made: none of the tokens that it grew out of was cut off before it grew."""
        grew = {token: len(born)}
        while left[token] >= 0:
            grew[left[token]] = born[token]
            token = left[token]
        while state:
            if since[state] <= grew.get(lacks[state], -1):
                return False
            state = origin[state]
        return True

    def _number(self, born: list[int], left: list[int], grows: list[list[int]]) -> None:
        """Numbers tokens so that each is followed by its growths, the latest first."""
        n = len(born)
        self._size = size = [1] * n
        by_age = sorted(range(n), key=born.__getitem__)
        for c in reversed(by_age):
            if left[c] >= 0:
                size[left[c]] += size[c]
        self.number = number = [0] * n
        at = 0
        for c in by_age:
            if left[c] < 0:
                number[c] = at
                at += size[c]
        for c in by_age:
            at = number[c] + 1
            for d in reversed(grows[c]):
                number[d] = at
                at += size[d]

    def _tables(self, born: list[int], grows: list[list[int]], origin: list[int], lacks: list[int], since: list[int]) -> None:
        """Rows of the reachable states: the bounds of the intervals of absent arcs."""

        def interval(s: int) -> tuple[int, int]:
            begin = self.number[lacks[s]]
            end = begin + 1
            for c in reversed(grows[lacks[s]]):
                if born[c] < since[s]:
                    break
                end += self._size[c]
            return begin, end

        spans = [(0, 0), *map(interval, range(1, len(origin)))]
        live = sorted({0, *self.target})
        place = {s: i for i, s in enumerate(live)}
        self.target = [place[s] for s in self.target]
        bounds, offsets = array("i"), array("i", [0])
        for s in live:
            found = []
            while s:
                found.append(spans[s])
                s = origin[s]
            end = -1
            for a, b in sorted(found):
                if a > end:
                    bounds.extend((a, b))
                elif b > end:
                    bounds[-1] = b
                end = max(end, b)
            offsets.append(len(bounds))
        self.bounds, self.offsets = bounds, offsets
        del self._size

    def allows(self, state: int, token: int) -> bool:
        """Whether the state has an arc of that label."""
        if token in self.dead:
            return False
        lo = self.offsets[state]
        return not (bisect_right(self.bounds, self.number[token], lo, self.offsets[state + 1]) - lo) & 1

    def letters(self) -> dict:
        """The labels as a tree over bytes: byte -> (tree below, token within a word, token at its end)."""
        value = _byte_names()[1]
        root: dict = {}
        for i, label in enumerate(self.labels):
            if i in self.dead:
                continue
            last = bool(self.suffix) and label.endswith(self.suffix)
            path = [value[ch] for ch in (label.removesuffix(self.suffix) if last else label)]
            if not path:
                continue
            below = root
            for x in path[:-1]:
                below = below.setdefault(x, [{}, None, None])[0]
            node = below.setdefault(path[-1], [{}, None, None])
            if not last:
                node[1] = i
            if last or not self.suffix:
                node[2] = i
        return root


def _frozen(tree: dict) -> dict:
    return {x: (_frozen(below), inner, end) for x, (below, inner, end) in tree.items()}


class Words(dict):
    """Ids of words, as bytes of 32-bit numbers; remembers words within a fixed bound."""

    #: Words that are kept, and the bytes of the longest of them.
    LIMIT, LONGEST = 1 << 19, 32

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        code = word.encode("utf-8", "surrogateescape")
        found = array("i", self.find(code)).tobytes()
        if len(code) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Words and texts to ids and back, by a compiled automaton."""

    def __init__(self, automaton: Automaton, description: str, apart: str):
        self.automaton, self.tree = automaton, automaton.letters()
        self.text = Tokenizer.from_str(description)
        added = sorted(((t["content"], t["id"]) for t in json.loads(description)["added_tokens"]), key=lambda x: -len(x[0]))
        self.added = dict(added)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.added)) if added else None
        self.apart = re.compile(apart) if apart else None
        self.pattern = regex.compile(PATTERN)
        self.bytes_of = _byte_names()[1]
        self.known = Words(self.word)
        self.all_labels = list(automaton.labels)
        for label, i in self.added.items():
            self.all_labels += [""] * (i + 1 - len(self.all_labels))
            self.all_labels[i] = label

    def word(self, word: bytes) -> list[int]:
        """Ids of a word: the one path of the automaton that spells it.

        Arcs are tried longest first.  A place is reached by one path at most, so
        one that leads nowhere is never tried again.
        """
        a, n = self.automaton, len(word)
        target, number, bounds, offsets = a.target, a.number, a.bounds, a.offsets
        token = [None] * (n + 1)  # of those that begin at j, the one that ends at each place
        path, back, dead = [], [], set()
        j, state, last = 0, 0, n
        while j < n:
            node, k = self.tree, j
            while k < last:
                found = node.get(word[k])
                if found is None:
                    break
                k += 1
                node, token[k], end = found
            else:
                if k == n:
                    token[k] = end
            lo, hi = offsets[state], offsets[state + 1]
            while k > j:
                t = token[k]
                if t is not None and not (bisect_right(bounds, number[t], lo, hi) - lo) & 1 and k not in dead:
                    path.append(t)
                    back.append((j, state, k - 1))
                    j, state, last = k, target[t], n
                    break
                k -= 1
            else:
                dead.add(j)
                if not path:
                    raise ValueError("a word has a symbol that the vocabulary lacks")
                path.pop()
                j, state, last = back.pop()
        return path

    def pieces(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if self.apart is not None and (text.isascii() or not self.apart.search(text)):
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        # in the library's words a character stands for a byte
        back = self.bytes_of
        split = self.text.pre_tokenizer.pre_tokenize_str(self.text.normalizer.normalize_str(text))
        return [bytes(map(back.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in split]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, added tokens in it told first."""
        find = self.known.__getitem__
        if self.cut is None:
            return np.frombuffer(b"".join(map(find, self.pieces(text))), np.int32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(find, self.pieces(text[at : m.start()]))
            out.append(array("i", [self.added[m[0]]]).tobytes())
            at = m.end()
        out += map(find, self.pieces(text[at:] if at else text))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Labels of the arcs, joined as the library joins tokens of a file without a decoder."""
        return " ".join(map(self.all_labels.__getitem__, ids))


#: Fixed value: the pattern of the vocabulary's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_names() -> tuple[list[str], dict[str, int]]:
    """The printable character that stands for each byte in byte-level vocabularies, and the way back.

    Printable bytes of Latin-1 stand for themselves, the others follow from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    names = [chr(b if b in plain else next(rest)) for b in range(256)]
    return names, {c: b for b, c in enumerate(names)}


def disagreements() -> str:
    """A character class of all characters that the interpreter and the library don't treat alike, '' if there are none."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lines = "\n".join(every[11:])  # one a line, from beyond the line feed
    low = normalizers.Lowercase().normalize_str(lines), lines.replace("Σ", "σ").lower()
    apart = {c for c, x, y in zip(every[11:], *(x.split("\n") for x in low)) if x != y}
    text = "".join(every)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        apart |= set(regex.sub(kind, "", text)) ^ set(normalizers.Replace(Regex(kind), "").normalize_str(text))
    spans: list[list[int]] = []
    for c in sorted(map(ord, apart)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else ""


def _compile(data: bytes) -> tuple[Automaton, str, str]:
    """(automaton, the file without its model's tables, characters on which the library decides)."""
    file = json.loads(data)
    model = file["model"]
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"):
        if model.get(name):
            raise ValueError(f"{name} isn't supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    steps = json.dumps([file["normalizer"], file["pre_tokenizer"]])
    usual = json.dumps(PATTERN) in steps and all(f'"type": "{x}"' in steps for x in ("NFC", "Lowercase", "Split", "ByteLevel")) and "Removed" in steps
    text = file | {"model": model | {"vocab": {}, "merges": [], "end_of_word_suffix": None}, "truncation": None, "padding": None}
    return automaton, json.dumps(text), (disagreements() or r"(?!)") if usual else ""


_encoders: dict[int, Encoder] = {}


def _encoder(known) -> Encoder:
    key = id(known.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*known.value)
    return _encoders[key]


_compiled: dict[int, tuple] = {}


def _broadcast(df: DataFrame, path: str | None):
    data = read_vocabulary(path or vocabulary_path("word_bpe_49k.json"))
    key = hash(data)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = _compile(data)
    return df.sparkSession.sparkContext.broadcast(_compiled[key])


def bpe_encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text.

    Added tokens that stand in a text are its tokens, as the library has it; none
    is put around it.  A narrow pass; the compiled automaton, fixed by the
    vocabulary, is broadcast.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(ids_col)
    known = _broadcast(docs, vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(known)
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index(text_col)))
            found = [encoder.encode(t.decode("utf-8", "replace")) if t else np.empty(0, np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, ids_col])

    return spread(docs).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with the text that the ids decode to; null ids decode to the empty text."""
    bound_batches(rows.sparkSession)
    rows = rows.drop(out_col)
    known = _broadcast(rows, vocabulary)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(known)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            values, ends = ids.values.to_pylist(), ids.offsets.to_pylist()
            texts = [encoder.decode(values[s:e]) for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)
