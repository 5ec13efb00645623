import random

import public_tokenizers
import pytest
from fixtures import documents, frame
from tokenizers import Tokenizer

from cladeframe.llm.bpe_automaton import Automaton, Encoder, _compile, bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return Encoder(*_compile(f.read()))


def merged(word, merges):
    """Plain BPE: the earliest merge that applies, everywhere from the left, until none does."""
    word = list(word)
    rank = {m: k for k, m in enumerate(merges)}
    while True:
        known = [rank[p] for p in zip(word, word[1:]) if p in rank]
        if not known:
            return word
        x, y = merges[min(known)]
        out, i = [], 0
        while i < len(word):
            if i + 1 < len(word) and (word[i], word[i + 1]) == (x, y):
                out.append(x + y)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out


@pytest.mark.parametrize("seed", range(20))
def test_the_automaton_takes_the_encoding_and_no_other_sequence(seed):
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(12):
        x, y = rng.choice(tokens), rng.choice(tokens)
        if x + y not in tokens:
            merges.append((x, y))
            tokens.append(x + y)
    ids = {t: i for i, t in enumerate(tokens)}
    a = Automaton(ids, merges)

    def spellings(word, state):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            t = ids.get(word[:k])
            if t is not None and a.allows(state, t):
                for rest in spellings(word[k:], a.target[t]):
                    yield [word[:k], *rest]

    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert list(spellings(word, 0)) == [merged(word, merges)]


def test_merges_in_a_wrong_order_are_refused():
    ids = {t: i for i, t in enumerate(["a", "b", "ab", "aba"])}
    with pytest.raises(ValueError, match="after its use"):
        Automaton(ids, [("ab", "a"), ("a", "b")])
    with pytest.raises(ValueError, match="lacks"):
        Automaton(ids, [("b", "a")])


def test_texts_against_the_library(encoder, library):
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(1, 0x250), *range(1, 0x180), *range(0x370, 0x500), *range(0x4E00, 0x4E20)]]
    pool += ["İ", "Σ", "\U0001f600", "́", "̸", "՘", "\U0001e900", "‍", " ", " ", "\x1c", "\x85", "　", "\U00010940"]
    for i in range(4000):
        text = "".join(rng.choice(pool if i % 3 else "abehtinorsT' s1.,") for _ in range(rng.randrange(60)))
        if i % 5 == 0:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>x", " <|endoftext|> Y"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_very_long_word(encoder, library):
    text = "abab" * 20000 + " é" + "日本" * 5000
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_operators_on_odd_rows(spark, library):
    docs = documents()
    df = frame(spark, docs).selectExpr("*", "1 AS ids", "'x' AS decoded")
    got = bpe_decode(bpe_encode(df)).collect()
    assert got[0].asDict().keys() == set(df.columns) and len(got) == len(docs)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_null_ids_and_empty_tables(spark):
    assert bpe_decode(spark.createDataFrame([(1, None)], "n int, ids array<int>")).first().decoded == ""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(empty)).count() == 0


def test_a_missing_vocabulary_is_told(spark):
    with pytest.raises(FileNotFoundError, match="absent"):
        bpe_encode(spark.createDataFrame([("a",)], "text string"), vocabulary="/nowhere.json")
