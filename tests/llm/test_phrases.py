import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest

from bytequarry.llm import phrases
from tests.llm.helpers import SCHEMA, awkward


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, most, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for d in range(1, most + 1):
                f[lang].update(tuple(w[k : k + d]) for k in range(len(w) - d + 1))
    out = []
    for lang, counted in f.items():
        often = {g: a for g, a in counted.items() if a >= least}
        inside = defaultdict(int)
        for g, a in often.items():
            for d in range(2, len(g)):
                for k in range(len(g) - d + 1):
                    inside[g[k : k + d]] = max(inside[g[k : k + d]], a)
        kept = []
        for g, a in often.items():
            if len(g) > 1 and inside[g] < a:
                score, k = min((1000 * a * n[lang] // (often[g[:k]] * often[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), often[g[:k]], often[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def docs(spark, rows, clash=False):
    if not clash:
        return spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], SCHEMA)
    return spark.createDataFrame([(i, t, g, "x", 1, None, None, None) for i, t, g in rows], f"{SCHEMA}, phrase string, n long, score long")


def prose(seed, texts, vocab=12):
    rng = random.Random(seed)
    word = [f"w{k}é" if k % 3 else f"W{k}" for k in range(vocab)]
    fixed = ["new York city", "of the of the", "a a a a a a", "x\ty  z", "ß . ß ß"]
    line = lambda: " ".join(rng.choice(word) if rng.random() < 0.6 else rng.choice(fixed) for _ in range(rng.randint(0, 25)))
    return [(k, "".join(line() + rng.choice([". ", ",", "\n", "!?", " \r\n"]) for _ in range(rng.randint(0, 4))), rng.choice(["en", "de", None, "und", ""])) for k in range(texts)]


def result(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


@pytest.mark.parametrize(("most", "least", "top"), [(5, 4, 1000), (2, 3, 5), (3, 2, 50)])
def test_equals_brute_force(spark, most, least, top):
    rows = prose(1, 200) + [(i, t, s) for i, t, s in awkward()]
    assert result(phrases.collocations(docs(spark, rows, clash=True), most=most, least=least, top=top)) == brute(rows, most, least, top)


def test_several_scans_weak_sketch_and_long_texts(spark, monkeypatch):
    # a sketch of few bits bounds little: more candidates, the same result; long texts are cut at pieces
    monkeypatch.setattr(phrases, "AUTOMATON_LETTERS", 300)
    monkeypatch.setattr(phrases, "LEAST_CELLS", 1 << 6)
    rows = prose(2, 120)
    assert result(phrases.collocations(docs(spark, rows), least=3)) == brute(rows, 5, 3, 2000)
    long = "one two. " * 40 + "x " * 600 + "end, one two"
    whole = phrases.Look(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), ["en"])
    cut = [phrases.Look(np.frombuffer(long.encode(), np.uint8)[a:b], np.array([0, b - a]), ["en"]) for a, b in phrases.stretches(np.frombuffer(long.encode(), np.uint8), phrases.BREAK, 50)]
    assert len(cut) > 2
    for n in (1, 2, 3):
        assert Counter(whole.grams(n)[1].tolist()) == Counter(h for c in cut for h in c.grams(n)[1].tolist())


def test_guards():
    look = phrases.Look(np.frombuffer("A b,c\tD  e\n\nf".encode() + "é x".encode(), np.uint8), np.array([0, 13, 17]), ["en", "fr"])
    assert phrases.guarded(look, 0) == " a b \n c d e \n f \n"
    assert phrases.guarded(look, 1) == " é x \n"


def test_empty_and_products_beyond_64_bits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None), (2, "", "en"), (3, " .,", "en")])).count() == 0
    score = spark.sql("select (cast(9000000000000 as decimal(18,0)) * cast(90000000000000 as decimal(18,0)) * cast(1000 as decimal(4,0))) div (cast(3000000000000 as decimal(18,0)) * cast(10000000000000 as decimal(18,0))) as s").first().s
    assert score == 27000


def test_texts_are_read_once_however_many_candidates(spark, monkeypatch, tmp_path):
    """each automaton's worth of candidates was one more scan of all texts."""
    monkeypatch.setattr(phrases, "AUTOMATON_LETTERS", 200)
    monkeypatch.setattr(phrases, "STRETCHES", 500)

    def noted(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = prose(5, 150)
    table = docs(spark, rows).coalesce(1).mapInArrow(noted, SCHEMA)
    assert result(phrases.collocations(table, least=3)) == brute(rows, 5, 3, 2000)
    assert len(list(tmp_path.iterdir())) == 1


def test_codes_of_words_and_stretches():
    signs = phrases._signs(120_000)
    assert len({bytes(s) for s in signs}) == 120_000 and not set(signs[1:, 0]) & set(signs[1:, 1:].ravel())
    joined = phrases._joined(np.array([5, 6, 7, 0, 8, 9, 0]), np.array([0, 4]), np.array([3, 2]))
    assert joined.tolist() == [5, 6, 7, 0, 8, 9, 0]
    seen, h = phrases.Seen(4), np.arange(1, 40, dtype=np.uint64) << np.uint64(20)
    assert set(seen.new(np.r_[h, h]) % len(h)) == set(range(len(h)))
