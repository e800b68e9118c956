import re

import numpy as np
import pytest

from bytequarry.llm import neardup
from bytequarry.llm.graph import components
from tests.llm.helpers import SCHEMA, awkward, docs


def brute(rows, n):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [4, 5])
def test_equals_brute_force(spark, n):
    rows = awkward()
    got = neardup.near_duplicates(docs(spark, rows, clash=True), n=n)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, n)


def test_chain_and_large_group(spark):
    # each text differs from the next by one word: neighbours are similar, the ends are not
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(0, 60, 2):
        words = [*words]
        words[k] = f"n{k}"
        rows.append((100 - k, " ".join(words), "a"))
    rows += [(200 + k, rows[0][1].upper(), "a") for k in range(40)]
    got = neardup.near_duplicates(docs(spark, rows), n=4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, 4)


def test_keep_one_keeps_rows_and_columns(spark):
    rows = awkward()
    table = docs(spark, rows, clash=True)
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert (4, rows[3][1]) in got
    assert not [r for r in got if r[0] in (5, 6)]
    assert [r[0] for r in got].count(7) == 2
    assert [r[0] for r in got].count(None) == 1
    assert len(got) == len(rows) - 3
    twice = docs(spark, [(1, "a b c d e f", "x")] * 3 + [(None, "g h i j k", "x")] * 2)
    assert sorted((r.doc_id or 0) for r in neardup.keep_one(twice).collect()) == [0, 1]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.keep_one(empty).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for shared in (0.2, 0.5, 0.8, 1.0):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
            k = int(round(2000 * shared / (1 + shared) / 2))
            a, b = np.unique(pool[:1000]), np.unique(np.r_[pool[:k], pool[1000 : 2000 - k]])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(float(neardup.estimate(neardup.registers(a), neardup.registers(b), np.array(len(a)), np.array(len(b)))) - true)
        assert abs(np.mean(errors)) < 0.02


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (70, 60), (70, 60)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 60: 60, 70: 60}
