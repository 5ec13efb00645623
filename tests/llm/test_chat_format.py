import pytest
from fixtures import frame
from pyspark.sql import functions as F

from cladeframe.llm.chat_format import mask_text, perspectives

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hello"),
    (1, 2, "bob b", "Hé <|im_end|> 💥"),
    (1, 3, "ann", None),
    (2, 0, "system", "alone"),
    (3, 5, None, "who"),
    (3, 5, "", "who"),
    (3, None, "ann", "late"),
    (3, None, "ann", "late"),
    (4, 1, "ann", "x"),
    (4, 70, "bob", "y"),
    (5, -9000, "é", "below"),
    (5, 2**40, "ü", "z" * 300_000),
    (None, 1, "ann", "z"),
]


def brute(turns, part=None):
    out = {}
    for c in {t[0] for t in turns}:
        own = sorted((t[1] is None, t[1] or 0, t[2] or "unknown", (t[3] or "").replace("<|", "< |")) for t in turns if t[0] == c)
        for who in {o[2] for o in own} - {"system"}:
            text, rows = "", {}
            for i, (_, _, role, body) in enumerate(own):
                head = "assistant" if role == who else "system" if role == "system" else "user name=" + "".join(x if x.isascii() and (x.isalnum() or x in "_-") else "_" for x in role)
                n, piece, masks = rows.get(i // part if part else 0, (0, (len(text), ""), []))
                begin, text = len(text), text + f"<|im_start|>{head}\n{body}<|im_end|>\n"
                if role == who:
                    masks = [*masks, (len(text) - 11 - len(body), len(text) - 1)]
                rows[i // part if part else 0] = (n + 1, (piece[0], piece[1] + text[begin:]), masks)
            for p, (n, (at, piece), masks) in rows.items():
                out[c, who, p] = (at, n, piece, masks)
    return out


@pytest.mark.parametrize("part", [None, 1, 3])
def test_every_perspective(spark, part):
    got = {(r.conv_id, r.perspective, r.part): (r.offset, r.n_turns, r.rendered, [tuple(m) for m in r.masks]) for r in perspectives(frame(spark, TURNS, SCHEMA), part).collect()}
    assert got == brute(TURNS, part)


def test_masks_are_the_speakers_words(spark):
    got = {r.perspective: r for r in perspectives(frame(spark, TURNS, SCHEMA)).where("conv_id = 1").collect()}
    assert [got["ann"].rendered[a:b] for a, b in got["ann"].masks] == ["Hello<|im_end|>", "<|im_end|>"]


@pytest.mark.parametrize("part", [None, 5])
def test_no_python_in_the_plan(spark, part):
    df = perspectives(frame(spark, TURNS, SCHEMA), part).select(mask_text(F.col("masks")))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_dialogues_are_whole(spark):
    turns = [(9, i, ["ann", "bob"][i % 2], f"t{i}") for i in range(1000)] + [(8, i, ["ann", "bob"][i % 2], "x") for i in range(60, 70)]
    df = frame(spark, turns, SCHEMA).withColumn("part", F.lit(7)).withColumn("perspective", F.lit("x")).withColumn("range", F.lit(1))
    got = perspectives(df).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(8, 10), (8, 10), (9, 1000), (9, 1000)]
    whole = {(r.conv_id, r.perspective): r.rendered for r in got}
    cut = perspectives(df, 300).collect()
    assert sorted(r.n_turns for r in cut if r.conv_id == 9) == [100, 100] + [300] * 6
    for c, p in whole:
        own = sorted((r for r in cut if (r.conv_id, r.perspective) == (c, p)), key=lambda r: r.part)
        assert "".join(r.rendered for r in own) == whole[c, p]
        assert all(whole[c, p][a:b].endswith("<|im_end|>") for r in own for a, b in r.masks)


def test_many_null_and_equal_turns(spark):
    turns = [(1, None, "ann", f"n{i % 50}") for i in range(3000)] + [(1, 7, "bob", "same")] * 2000
    got = perspectives(frame(spark, turns, SCHEMA), 100).collect()
    assert len(got) == 100 and all(r.n_turns == 100 for r in got)
    assert perspectives(frame(spark, [], SCHEMA)).count() == 0 == perspectives(frame(spark, [], SCHEMA), 10).count()
