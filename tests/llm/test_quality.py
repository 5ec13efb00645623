import math
import random
from collections import Counter
from fractions import Fraction

from fixtures import documents, frame, words
from pyspark.sql import functions as F

from cladeframe.llm.quality import BASE, LADDERS, best_level, binomial_tail, certified, cutoffs, features, keep_good, known_labels, quality, ratios

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(9)
    out = documents()
    for i in range(20):
        line = " ".join(rng.choice("abcd") for _ in range(9))
        out.append((300 + i, "\n".join([line, "x # y", line, "", " \t", line][: rng.randrange(1, 7)]) + " <b>" * (i % 3), "en", "s", 1))
    return out


def test_base_features(spark):
    docs = texts()
    got = quality(frame(spark, docs).withColumn("stratum", F.lit("q")).withColumn("kept", F.lit(1)), frame(spark, [], LABELS))
    have = sorted(((r.doc_id, *(r[b] for b in BASE), r.base_failed) for r in got.collect()), key=str)
    assert have == sorted(((d[0], *brute(d[1])) for d in docs), key=str)
    assert all(r.kept != r.base_failed for r in got.collect())  # no labels certify nothing
    assert quality(frame(spark, []), frame(spark, [], LABELS)).count() == 0


def test_binomial_tail_and_certificates():
    assert abs(binomial_tail(0, 100, 0.02) - 0.98**100) < 1e-12
    assert abs(binomial_tail(2, 10, 0.5) - 56 / 1024) < 1e-12
    assert binomial_tail(10, 10, 0.5) == 1.0
    assert certified(1000, [0, 0, 3, 40, 0], 0.02, 0.01) == 3  # stops at the first that fails
    assert certified(50, [0, 0], 0.02, 0.01) == 0  # too few labels
    assert certified(0, [0], 0.02, 0.01) == 0


def test_best_level():
    assert best_level([0, 0, 1], [3, 9, 15], 3) == 2  # the last step catches six and loses one
    assert best_level([0, 0, 0], [0, 0, 0], 3) == 0 and best_level([0, 0], [5, 5], 2) == 1 and best_level([], [], 0) == 0
    assert best_level([0, 0], [5, 9], 1) == 1


def big(seed, n, bad_every):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(40)]
        bad = i % bad_every == 0
        if bad:
            w = [x + "###" for x in w]
        lang = "en" if i % 10 else "xx"
        docs.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_cutoffs_reject_bad_rows_and_keep_good_ones(spark):
    docs, labels = big(1, 3000, 7)
    labels += [(None, 1, 0), (1, None, 0), (2, 1, 0)]
    f = features(frame(spark, docs))
    cuts = {r.stratum: r for r in cutoffs(f, known_labels(frame(spark, labels, LABELS))).collect()}
    assert cuts["en"].symbol_ratio_cut in LADDERS["symbol_ratio"] and cuts["en"].n_good == sum(1 for i in range(3000) if i % 10 and i % 7)
    assert cuts["xx"].symbol_ratio_cut is None  # 300 labels are too few for this level
    got = {r.doc_id: r.kept for r in quality(frame(spark, docs), frame(spark, labels, LABELS)).collect()}
    good = {i for i, q, _ in labels if q and i is not None}
    assert all(got[i] for i in good)
    assert not any(got[i] for i in range(3000) if i % 7 == 0 and i % 10)
    kept = keep_good(frame(spark, docs).withColumn("n_words", F.lit("mine")).withColumn("row", F.lit(1)), frame(spark, labels, LABELS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "row"]
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def brute_kept(docs, labels, alpha=0.02, delta=0.05, worth=10):
    """Verdicts with cutoffs chosen here: exact binomials as fractions, fixed sequences, Bonferroni."""
    quality_of = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            quality_of[i] = min(q, quality_of.get(i, q))
    rows = []
    for d in docs:
        n, chars, symbols, dups, repeats, failed = brute(d[1])
        lines = len([x for x in (d[1] or "").split("\n") if words(x)])
        per = lambda a, b: a / b if b else 0.0
        rows.append((d, failed, {"symbol_ratio": per(symbols, chars), "repeat_ratio": per(repeats, n), "dup_line_ratio": per(dups, lines), "long_word_ratio": per(chars, n)}))
    held: dict = {}
    for d, failed, ratio in rows:
        if not failed and d[0] in quality_of:
            own = held.setdefault(d[2], {})
            own[d[1]] = (min(quality_of[d[0]], own.get(d[1], (1,))[0]), ratio)
    cut = {}
    for lang, texts_of in held.items():
        good = [r for q, r in texts_of.values() if q == 1]
        bad = [r for q, r in texts_of.values() if q != 1]
        for name, ladder in LADDERS.items():
            p, level, best, allowed = Fraction(alpha) / 4, delta / len(held) / 4, (0, None), True
            for c in ladder:
                k = sum(r[name] > c for r in good)
                tail = sum(math.comb(len(good), i) * p**i * (1 - p) ** (len(good) - i) for i in range(k + 1)) if k <= p * len(good) else 1
                allowed = allowed and k <= p * len(good) and len(good) > 0 and tail <= level
                gain = sum(r[name] > c for r in bad) - worth * k
                if allowed and gain > best[0]:
                    best = (gain, c)
            cut[lang, name] = best[1]
    return sorted(((d[0], not failed and not any(cut.get((d[2], n)) is not None and x > cut[d[2], n] for n, x in ratio.items())) for d, failed, ratio in rows), key=str)


def test_verdicts_against_brute_force(spark):
    for seed, every in ((1, 7), (2, 3)):
        docs, labels = big(seed, 1500, every)
        docs += texts()
        docs += [(5000 + i, docs[7][1], "en", "s", 1) for i in range(300)]  # copies of one labelled text are one draw
        labels += [(5000 + i, 1, 0) for i in range(300)] + [(None, 1, 0), (4, None, 0), (8, 0, 0), (8, 1, 0)]
        got = quality(frame(spark, docs), frame(spark, labels, LABELS))
        assert sorted(((r.doc_id, r.kept) for r in got.collect()), key=str) == brute_kept(docs, labels)
        assert sorted((r.doc_id for r in keep_good(frame(spark, docs), frame(spark, labels, LABELS)).collect()), key=str) == sorted((i for i, k in brute_kept(docs, labels) if k), key=str)


def test_copies_are_one_draw(spark):
    """Ten texts, a hundred copies of each, certify no more than ten rows do."""
    docs = [(i, " ".join(f"w{i % 10}x{j}" for j in range(40)), "en", "s", 1) for i in range(1000)]
    labels = [(i, 1, 0) for i in range(1000)]
    got = cutoffs(features(frame(spark, docs)), known_labels(frame(spark, labels, LABELS))).collect()
    assert [r.n_good for r in got] == [10]


def test_very_long_text(spark):
    long = "\n".join(" ".join(f"a{(i * 7 + j) % 900}" for j in range(50)) for i in range(4000))
    got = quality(frame(spark, [(1, long, "en", "s", 1), (2, None, None, None, None)]), frame(spark, [], LABELS)).collect()
    assert sorted((r.doc_id, *(r[b] for b in BASE), r.base_failed) for r in got) == sorted([(1, *brute(long)), (2, *brute(None))])


def test_false_rejection_on_fresh_rows_is_limited(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("abcdefg"[: rng.randrange(2, 8)] + str(rng.random())[2:5] + ("#" if rng.random() < 0.06 else "") for _ in range(60)), "en", "s", 1) for i in range(6000)]
    labels = [(i, 1, 0) for i in range(3000)]
    out = quality(frame(spark, docs), frame(spark, labels, LABELS), alpha=0.04).where("doc_id >= 3000")
    assert 1 - out.where("kept").count() / 3000 <= 0.04
    assert set(ratios()) == set(LADDERS)
