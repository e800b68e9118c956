import hashlib

from bytequarry.llm import imatch
from tests.llm.helpers import SCHEMA, awkward, docs


def test_neighbours_hashes_and_likeness(spark):
    rows = awkward() + [(300, "same words as another", "a"), (301, "same words as another", "a")]
    got = imatch.fingerprints(docs(spark, rows, clash=True).repartition(3)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for (i, t, _), (_, n, _) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    text = {h: t for (i, t, _), (_, _, h) in zip(order, want)}
    for r in got:
        prints.setdefault(text[r.edited_sha256] or "", set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1
        assert 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    assert next(r for r in got if r.doc_id == 301).near_next == 1.0


def test_lexicon_is_the_band(spark):
    rows = [(k, "always " + ("half " if k % 2 else "") + f"only{k}", "a") for k in range(20)]
    import math

    found = {r.h for r in imatch.lexicon(docs(spark, rows), band=(math.log(1.5), math.log(5))).collect()}
    half = spark.sql("select xxhash64('half') as h").first().h
    assert found == {half}


def test_parts_of_a_text_are_felt(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 20 : k * 20 + 60]), "a") for k in range(17)] * 1
    rows += [(100 + k, " ".join(words[k * 20 : k * 20 + 50] + words[300:310]), "a") for k in range(12)]
    got = imatch.fingerprints(docs(spark, rows)).collect()
    assert sum(r.near_edited for r in got) > 2 * sum(r.near_next for r in got)


def test_one_row_and_no_rows(spark):
    (r,) = imatch.fingerprints(docs(spark, [(5, "ab cd", "a")])).collect()
    assert r.near_next == 1.0
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert imatch.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_and_likeness_equal_plain_sets(spark):
    """Lexicon, sub-lexicons, equality of fingerprints and both likenesses, from sets of terms."""
    import math
    import random

    import xxhash

    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(120)]
    rows = awkward() + [(1000 + k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) + rng.choice(["", "!", " T1 t1"]), "a") for k in range(80)]
    band = (math.log(1.5), math.log(40))
    signs = str.maketrans(imatch.PUNCTUATION, " " * len(imatch.PUNCTUATION))
    terms = lambda t: {w for w in (t or "").lower().translate(signs).split(" ") if w}
    df = {}
    for _, t, _ in rows:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    number = lambda data, seed: xxhash.xxh64(data, seed).intdigest()
    lexicon = {w: number(w.encode(), 42) for w, n in df.items() if band[0] <= math.log(len(rows) / n) <= band[1]}
    keeps = lambda h, k: number(k.to_bytes(4, "little"), number(h.to_bytes(8, "little"), 42)) % (1 << imatch.HALVINGS[k]) == 0
    kept = {w: [keeps(h, k) for k in range(len(imatch.HALVINGS))] for w, h in lexicon.items()}
    subsets = lambda t: [frozenset(w for w in terms(t) if w in kept and kept[w][k]) for k in range(len(imatch.HALVINGS))]

    def alike(a, b):
        pairs = [(x, y) for x, y in zip(subsets(a), subsets(b)) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else float(terms(a) == terms(b))

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want, prints = [], {}
    for (i, t, _), (_, n, _) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.append((str(i), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, n), 9)))
        prints[want[-1][1]] = edited
    got = imatch.fingerprints(docs(spark, rows), band=band).collect()
    assert sorted((str(r.doc_id), r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    by_sets, by_print = {}, {}
    for r in got:
        t = prints[r.edited_sha256]
        key = tuple(subsets(t)) if any(subsets(t)) else frozenset(terms(t))
        by_sets.setdefault(key, set()).add(r.edited_fingerprint)
        by_print.setdefault(r.edited_fingerprint, set()).add(key)
    assert all(len(v) == 1 for v in [*by_sets.values(), *by_print.values()])
