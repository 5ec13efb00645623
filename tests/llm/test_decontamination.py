import random

import numpy as np
from fixtures import documents, frame
from pyspark.sql import functions as F

from cladeframe.llm.decontamination import Index, banded, contamination, decontaminate, normalise

BENCH = "item_id long, text string"


def edit_distance_inside(a, b):
    """Least edits of all of ``a`` against any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a = bytes(rng.choice(b"abc") for _ in range(12))
        b = bytes(rng.choice(b"abc") for _ in range(30))
        want = edit_distance_inside(a, b)
        got = banded(a, b, 0, 30, 4)
        assert (got[2] if got else 99) == (want if want <= 4 else 99)
        if got:
            assert edit_distance_inside(a, b[got[0] : got[1]]) == got[2]


def test_normalise():
    b, at = normalise("  Ab,\n C—É!! d".encode())
    assert b.tobytes().decode() == "ab c—é d" and len(b) == len(at)
    assert normalise(b"")[0].tobytes() == b""


def changed(text, edits, rng):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        t[at : at + rng.choice([0, 1])] = rng.choice(["z", "", "q"])
    return "".join(t)


def setting(seed=3):
    rng = random.Random(seed)
    docs = [d for d in documents(n=40) if d[1] is None or len(d[1]) < 3000]
    say = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwé") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    items = [(i, say(rng.randrange(12, 45))) for i in range(12)] + [(50, None), (51, ""), (None, say(20)), (52, "short")]
    planted = {}
    for k, (i, t) in enumerate(items[:12]):
        base = say(30)
        for kind, text in (("exact", t), ("upper", t.upper()), ("spaced", t.replace(" ", " \n ")), ("near", changed(t, 3, rng))):
            key = 1000 + 10 * k + len(planted) % 4
            planted[key] = (i, kind)
            docs.append((key, f"{base}. {text}! {base}", "en", "s", 1))
    long = items[3][1] if len(items[3][1]) > 210 else max((t for _, t in items[:12]), key=len)
    docs.append((3000, say(20) + " " + long[:170] + " " + say(20), "en", "s", 1))
    return docs, items, planted


def test_planted_passages_are_found_and_clean_rows_left(spark):
    docs, items, planted = setting()
    hits = contamination(frame(spark, docs).withColumn("item_id", F.lit(1)), frame(spark, items, BENCH)).collect()
    got = {(r.doc_id, r.item_id) for r in hits}
    assert {(d, i) for d, (i, _) in planted.items()} <= got
    assert {d for d, _ in got} <= set(planted) | {3000} and 3000 in {d for d, _ in got}
    texts = {d[0]: d[1] for d in docs}
    for r in hits:
        whole = normalise(dict(items)[r.item_id].encode())[0].tobytes().strip()
        region = normalise(texts[r.doc_id].lower().encode()[r.start : r.end])[0].tobytes()
        assert edit_distance_inside(region.strip(), whole) <= 2 * 8


def test_groups_of_items_give_the_same(spark):
    docs, items, _ = setting()
    one = contamination(frame(spark, docs), frame(spark, items, BENCH))
    many = contamination(frame(spark, docs), frame(spark, items, BENCH), group_bytes=800)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    kept = decontaminate(frame(spark, docs).withColumn("hit", F.lit(1)), frame(spark, items, BENCH), group_bytes=800)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "hit"]
    bad = {r.doc_id for r in one.collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_a_changed_word_and_a_copied_part():
    rng = random.Random(12)
    say = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(5)) for _ in range(k))
    for n in (14, 20, 40):
        t = say(n).split()
        index = Index([(1, " ".join(t).encode())])
        t[n // 2] = "zzzzz"
        assert index.search([f"{say(9)} {' '.join(t)} {say(9)}".encode()])
    t = say(40)
    index = Index([(1, t.encode())])
    assert index.search([(say(20) + " " + t[40:125] + " " + say(20)).encode()])
    assert not index.search([(say(20) + " " + t[40:80] + " " + say(20)).encode()])


def test_bounds_and_empty_tables(spark):
    docs, items, _ = setting()
    assert contamination(frame(spark, docs), frame(spark, [], BENCH)).count() == 0
    assert contamination(frame(spark, []), frame(spark, items, BENCH)).count() == 0
    index = Index([(i, t.encode()) for i, t in items if t])
    assert (index.bound > 0).all() and len(index.items) == 13
    assert np.all(index.budget >= 0)


def test_filter_never_loses_a_region_within_budget():
    rng = random.Random(5)
    for _ in range(60):
        t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100)).strip().encode()
        index = Index([(1, t)], ((100, 0.08),))
        item = index.items[0]
        budget = item[2][0][2]
        text = changed(t.decode(), budget, rng)
        if edit_distance_inside(item[1], normalise(text.encode())[0].tobytes()) <= budget:
            pad = "".join(rng.choice("rstuvwxyz") for _ in range(50))
            assert index.search([f"{pad} {text} {pad}".encode()])


def ends_within(needles, text, budget):
    """(end, edits) of each place where one of ``needles`` ends within ``budget`` edits: Sellers' algorithm over the whole text."""
    n = np.array([np.frombuffer(x, np.uint8) for x in needles])
    step = np.arange(n.shape[1] + 1)
    row, out = np.tile(step, (len(n), 1)), []
    for e, c in enumerate(text, 1):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (n != c))
        new = np.hstack([np.zeros((len(n), 1), new.dtype), new])
        row = np.minimum.accumulate(new - step, axis=1) + step
        out += [(e, int(d)) for d in row[row[:, -1] <= budget, -1]]
    return out


def brute_regions(item, text):
    """(end, edits, budget) of each near place of each needle, needles and budgets written out."""
    out = []
    for window, rate in ((100, 0.08), (64, 0.0625)):
        w = min(len(item), window)
        k = min(int(rate * w), max(0, (w - 10) // 10))
        starts = {*range(0, len(item) - w + 1, window // 4), len(item) - w}
        out += [(e, d, k) for e, d in ends_within([item[s : s + w] for s in starts], text, k)]
    return out


def test_all_regions_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    items = [(i, say(n)) for i, n in enumerate((14, 30, 60, 9))] + [(4, say(30))]
    items[4] = (4, items[1][1][:90] + " " + items[4][1])  # shares a passage with another
    docs = []
    for i, t in items:
        docs.append((10 * i, f"{say(20)} {t} {say(30)} {changed(t, 3, rng)} {say(25)}", "en", "s", 1))  # two regions of one item
        docs.append((10 * i + 1, f"{t}! {t}", "en", "s", 1))
        docs.append((10 * i + 2, say(150) + f" {t[: len(t) // 2]} {say(40)} {t[len(t) // 2:]} " + say(150), "en", "s", 1))
        docs.append((10 * i + 3, t[: len(t) // 2], "en", "s", 1))  # texts laid end to end: no region of two rows
        docs.append((10 * i + 4, t[len(t) // 2 :], "en", "s", 1))
    docs.append((999, " ".join([items[0][1], say(6)] * 12), "en", "s", 1))
    got: dict = {}
    for r in contamination(frame(spark, docs), frame(spark, items, BENCH)).collect():
        got.setdefault((r.doc_id, r.item_id), []).append((r.start, r.end, r.edits))
    for doc, text, *_ in docs:
        flat, at = normalise(text.encode())
        for i, t in items:
            item = normalise(t.encode())[0].tobytes().strip()
            want = brute_regions(item, flat.tobytes())
            regions = got.get((doc, i), [])
            assert bool(want) == bool(regions), (doc, i)
            for e, _, k in want:  # every near place is in a region, but for the ends that edits move
                assert any(s - 2 * k <= at[e - 1] <= z + 2 * k for s, z, _ in regions), (doc, i, e)
            for s, z, edits in regions:  # every region holds a near place with its edits
                assert min(d for e, d, _ in want if s < at[e - 1] + 1 <= z) == edits, (doc, i, s, z)
            assert all(a[1] <= b[0] for a, b in zip(sorted(regions), sorted(regions)[1:]))
    assert all(len(got[10 * i, i]) == 2 for i in range(4)) and all(len(got[10 * i + 1, i]) == 2 for i in range(4))
    assert len(got[999, 0]) == 12


def test_very_long_text_and_repeated_rows(spark):
    rng = random.Random(9)
    say = lambda k: " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(k))
    item = say(30)
    docs = [(1, say(60_000) + " " + item + " " + say(60_000), "en", "s", 1)] + [(2, "x " + item, "en", "s", 1)] * 3 + [(None, item, "en", "s", 1), (3, None, None, None, None)]
    bench = frame(spark, [(1, item), (1, item), (2, item)], BENCH)
    rows = [(r.doc_id, r.item_id) for r in contamination(frame(spark, docs), bench).collect()]
    assert sorted(rows, key=str) == sorted([(d, i) for d in (1, 2, 2, 2, None) for i in (1, 1, 2)], key=str)
    assert [r.doc_id for r in decontaminate(frame(spark, docs), bench).collect()] == [3]
