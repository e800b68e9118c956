"""Awkward tables for every operator."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use themselves.
CLASHES = "tkey string, text_len long, size long, score double, rank long, k long, t long, o long, p double, whole long, last string, part long, place long, component_id long, media_index string, added string, label string, held string, batch long"


def docs(spark, rows, clash=False):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    if not clash:
        return spark.createDataFrame(rows, SCHEMA)
    extra = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"{SCHEMA}, {CLASHES}")


def awkward(seed=0):
    """Nulls, blanks, repeated rows and ids, ties, near copies, and a long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, base, "a"), (5, base, "b"), (5, base, "b"), (6, " ".join(near), None), (7, "x", "c"), (7, "y", "c"), (None, "no id here", "b"), (8, text(5000), "b")]
    return rows + [(20 + k, text(rng.randint(1, 60)), rng.choice("abc")) for k in range(30)]
