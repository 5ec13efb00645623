"""Small documents with planted copies, near copies, secrets, junk, nulls and ties; and brute forces."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def documents(seed: int = 11, n: int = 60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = say(20)
    out = []
    for i in range(n):
        t = say(rng.randrange(1, 120))
        if i % 5 == 0:
            w = t.split()
            at = rng.randrange(len(w) + 1)
            t = " ".join(w[:at] + passage.split() + w[at:])
        if i % 7 == 0 and out:
            t = rng.choice(out)[1]
        if i % 11 == 3 and out:
            w = rng.choice(out)[1].split()
            if w:
                w[rng.randrange(len(w))] = "CHANGED"
            t = "\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])])
        out.append((i * 3 % n, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t)))
    long = say(6000)
    out += [
        (100, None, "en", "s0", None),
        (101, "", None, None, 0),
        (102, " \t\n\x0b\x0c\r ", "fr", "s1", 7),
        (None, out[0][1], "en", "s2", 1),
        (None, say(30), "en", "s2", 1),
        (103, long, "en", "s0", len(long)),
        (104, long + " tail", "en", "s0", len(long)),
        (105, out[5][1], "en", "s1", 1),
        (105, out[5][1], "en", "s1", 1),
        (106, "one", "en", "s1", 3),
        (107, "ONE", "en", "s1", 3),
        (108, "\u00a0x\u2003y 💥 é\u0301", "en", "s1", 3),
    ]
    return out


def frame(spark, rows, schema=DOCS, partitions=5):
    return spark.createDataFrame(rows, schema).repartition(partitions)
