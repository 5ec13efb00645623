import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladeframe.llm import token_alignment
from cladeframe.llm.bpe_automaton import _byte_names
from cladeframe.llm.token_alignment import align, links


def brute(rows):
    """Whole texts by the libraries, all pairs of tokens of a text by a merge of their ends."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = _byte_names()[1]

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    known, counts = [], Counter()
    for doc_id, text in rows:
        known.append((doc_id, None))
        if not text:
            continue
        a = [(i, bytes(value[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in second.encode(text)]
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        a, b = spans
        both = [(x, y) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 300 else _merged(a, b)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        group = lambda x: bisect.bisect_left(cuts, x[2])  # noqa: E731,B023
        lists = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for x in side:
                lists[group(x)][k].append(str(x[0]))
        counts.update((x[0], y[0]) for x, y in both)
        known[-1] = doc_id, ([(x[0], y[0]) for x, y in both], len(a), len(b), len(cuts), ";".join("|".join(map(",".join, g)) for g in lists))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, x in known:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            pairs, *n, groups = x
            out.append((doc_id, *n, len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def _merged(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i], b[j]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b c"), (5, "foo  bar \n baz\n\n  x  "), (6, "<|endoftext|> <s> naïve 日本語 \U0001f600 x\0y"), (6, "<|endoftext|> <s> naïve 日本語 \U0001f600 x\0y"),
    (None, "the cat"), (7, "a᠎  b \xa0 c　 d"), (8, "don't  stop"), (9, "x" * 3000 + " y"), (10, "   "), (11, "\n"), (12, "tab\t end "), (13, "<0x41>     z"),
]


def run(df, **more):
    return sorted(map(tuple, align(df, **more).collect()), key=str)


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS chunk", "'x' AS id", "2 AS places", "3 AS word")
    assert run(df) == brute(ODD)


def test_documents(spark):
    docs = documents()
    assert run(frame(spark, docs)) == brute([(d[0], d[1]) for d in docs])


def test_white_space_of_all_kinds(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "of", "The", ".", "'s", " ", " ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "1", "é"]) for _ in range(rng.randrange(30)))) for i in range(300)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_many_chunks_give_the_same(spark):
    docs = documents()
    assert run(frame(spark, docs), places=50) == brute([(d[0], d[1]) for d in docs])


def test_links_are_all_overlaps(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k in range(40):
        total = rng.randrange(1, 30)
        spans = []
        for side in (0, 1):
            ends = sorted({*(rng.randrange(1, total + 1) for _ in range(rng.randrange(12))), total})
            own = [(1000 * side + i, a, b) for i, (a, b) in enumerate(zip([0, *ends], ends))]
            rows += [(k, side, i, t, b - a) for i, (t, a, b) in enumerate(own)]
            spans.append(own)
        want += [(k, x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
    got = links(spark.createDataFrame(rows, "k int, side int, place int, id int, size int"), ["k"], [])
    assert sorted((r.k, r.a, r.b) for r in got.collect()) == sorted(want)


def test_what_is_told_of_a_segment_is_packed(spark):
    """Words of 32 bits, beyond the signed range too; no list and no number of eight bytes is sent."""
    want = [(2, [1, 65535 << 16 | 65534, 0x10001], 3, 5 << 40 | 7), (0, [], 0, 0), (1, [1 << 31], 1, 2**62)]
    rows = spark.createDataFrame([(i, g, [c - (c >> 31 << 32) for c in codes], b, n) for i, (g, codes, b, n) in enumerate(want)], "i int, g long, codes array<int>, b long, n long")
    code = F.transform("codes", lambda c: token_alignment._big_endian(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8))
    one = F.concat(token_alignment._sums(F.col("b"), F.col("n")), F.unhex(F.concat(token_alignment._big_endian(F.col("g"), 8), F.array_join(code, ""))))
    packed = pa.array([bytes(r.one) for r in rows.select("i", one.alias("one")).orderBy("i").collect()], pa.binary())
    groups, best, count, codes, n = token_alignment._told(packed.take(pa.array([2, 0, 1])))
    got = np.split(codes, np.cumsum(n)[:-1])
    assert [(g, c.tolist(), b, k) for g, c, b, k in zip(groups.tolist(), got, best.tolist(), count.tolist())] == [want[i] for i in (2, 0, 1)]
    assert all(len(x) == 0 for x in token_alignment._told(pa.array([], pa.binary())))


def test_new_places_are_zeros():
    rng = random.Random(6)
    for _ in range(300):
        numbers = token_alignment._Numbers()
        for _ in range(4):
            before, size = len(numbers), rng.randrange(0, 40)
            own = np.array([numbers[str(rng.randrange(30))] for _ in range(size)], np.int32)
            packed = token_alignment._places_packed(own, before)
            assert token_alignment._places_unpacked(packed).tolist() == own.tolist()
            assert np.count_nonzero(token_alignment._unpacked(packed)[1:] == 0) == len(numbers) - before


def test_an_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_a_model_whose_pieces_go_on_over_a_space_is_refused(monkeypatch):
    class Model:
        def __init__(self, model_proto):
            pass

        vocab_size = lambda self: 1
        is_byte = is_control = is_unknown = lambda self, i: False
        id_to_piece = lambda self, i: "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="over a space"):
        token_alignment.Pieces(b"")


def test_rows_of_a_chunk_travel_packed():
    """What segments tell comes back as it was, in less than half the bytes of single rows."""
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 4), int(rng.zipf(1.3)) % 10**6, rng.integers(0, 60000, rng.integers(1, 5))) for _ in range(20000)]
    told = pa.array([np.array([c, 0, b, len(k), *k], ">u4").tobytes() for b, c, k in rows], pa.binary())
    places = rng.permutation(40000)[:20000].astype(np.int32)
    of = np.sort(rng.integers(0, 3, 20000))
    table = pa.table({"of": of, "place": places, "packed": told})
    back = [(x["of"].as_py(), token_alignment._rows_unpacked(x["rows"].as_py())) for b in token_alignment._gathered(iter(table.to_batches(1000))) for x in [dict(zip(("of", "rows"), (b.column(0)[0], b.column(1)[0])))]]
    got = sorted((c, p, w) for c, (at, words) in back for p, w in zip(at.tolist(), words.to_pylist()))
    assert [c for c, _ in back] == [0, 1, 2]
    assert got == sorted(zip(of.tolist(), places.tolist(), told.to_pylist()))
    sent = sum(b.nbytes for b in token_alignment._gathered(iter(table.to_batches(1000))))
    assert 2 * sent < told.nbytes + 16 * len(told)
    assert list(token_alignment._gathered(iter(table.slice(0, 0).to_batches()))) == []
