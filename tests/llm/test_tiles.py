import random
import re

import numpy as np
import pytest

from bytequarry.llm import tiles
from tests.llm.helpers import SCHEMA, awkward, docs


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows)), key=str)


def result(found):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 60), (1, 30)])
def test_equals_brute_force(spark, n, percent):
    rows = awkward()
    assert result(tiles.jaccard_join(docs(spark, rows, clash=True), n=n, percent=percent)) == brute(rows, n, percent)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 2)
    return words


def families(seed, sizes, members, most):
    """Near copies around the threshold, chains of them, and texts of one template that stay below it."""
    rng, rows = random.Random(seed), []
    for f, size in enumerate(sizes):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        chain = base
        for _ in range(members):
            chain = edited(rng, rng.choice([base, chain]), rng.randint(1, max(1, most * size // 1000)))
            rows.append((len(rows), " ".join(chain), "a"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_families_around_the_threshold(spark, block, monkeypatch):
    # links are decided by full sets; with small blocks all ways of meeting within a tile run
    monkeypatch.setattr(tiles, "BLOCK", block)
    rows = families(3, [1, 5, 9, 12, 20, 33, 60, 120, 300], 14, 40)
    assert result(tiles.jaccard_join(docs(spark, rows))) == brute(rows, 3, 90)


def test_templates_stay_apart(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, " ".join([*base, *(f"o{rng.randrange(10**6)}" for _ in range(40))]), "a") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail", "b") for k in range(0, 60, 7)]
    assert result(tiles.jaccard_join(docs(spark, rows))) == brute(rows, 3, 90)


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(0)
    for size in [10, 11, 12, 18, 19, 20, 27, 40, 90, 200, 1000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            lost, more = rng.integers(0, 1 + size // 10, 2)
            b = np.unique(np.r_[rng.permutation(a)[lost:], rng.integers(0, 1 << 64, more, dtype=np.uint64)])
            if tiles.linked(a, b, 90):
                assert len(a) == len(b) == lost == 0 or np.array_equal(a, b) or len(np.intersect1d(tiles.tiles_of(a, 90)[0], tiles.tiles_of(b, 90)[0]))
                x, y = tiles.bitmap(a), tiles.bitmap(b)
                width = min(len(x), len(y))
                assert tiles.may_link(tiles.folded(x, width), len(a), tiles.folded(y, width)[None, :], np.array([len(b)]), 90).all()


def test_bands_hold_all_links():
    low, _ = tiles.bands(90)
    for size in range(1, 3000):
        band = int(np.searchsorted(low, size, "right")) - 1
        assert int(np.searchsorted(low, size * 100 // 90, "right")) - 1 <= band + 1


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tiles.jaccard_join(empty).count() == 0
    rows = [(1, "a b c d", "x")] * 3 + [(None, "a B c d", "x")] * 2 + [(None, None, "x"), (3, " ", "y")]
    assert result(tiles.jaccard_join(docs(spark, rows))) == brute(rows, 3, 90)
