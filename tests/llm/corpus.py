"""A small corpus with nulls, empty and long texts, copies, near copies, repeated rows and columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, gid long, n long, size long, key double, kept boolean, tokens string, bucket int, target double, units long"


def documents(seed=5, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 4, 5, 6, 20, 60, 90)))) for _ in range(n)]
    base = [rng.choice(words) for _ in range(100)]
    family = []
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(100)] = rng.choice(words)
        family.append(" ".join(t))
    texts += family + family[:5] + [family[0].upper()] * 3
    texts += ["", None, " \t\n\x0b\x0c\r ", "one", "one", "One", "a b c d", "a\x1fb c d", "é ü ß x\u00a0y z", " ".join(rng.choice(words) for _ in range(20000)), None, ""]
    rows = [(i * 3 % 1009, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "é", "z", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, family[1], None, None, 5), (None, "nothing like it at all here", "en", "s1", 3), rows[130], rows[130]]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA)
