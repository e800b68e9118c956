import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bytequarry.llm import resample
from tests.llm.helpers import SCHEMA, awkward, docs


def tokens(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def grams(text, n):
    w = tokens(text)
    return [b" ".join(w[k : k + d]) for d in range(1, n + 1) for k in range(len(w) - d + 1)]


def brute(rows, target, n, buckets, percent, least):
    s, t = (Counter(zlib.crc32(g) % buckets for text in texts for g in grams(text, n)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text, _ in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in (zlib.crc32(g) % buckets for g in grams(text, n)))
        out.append([i, len(grams(text, n)), weight, weight + resample.noise(i, 7), None, len(tokens(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_brute_force(spark, n):
    rows = awkward()
    target = [rows[3][1], None, "", "abc dé, ß-a X1"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs(spark, rows, clash=True), bench, n=n, buckets=50, percent=40, least_words=5, seed=7)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=str) == brute(rows, target, n, 50, 40, 5)


def test_long_text_goes_in_stretches():
    text = " ".join(f"w{k % 37}é{k % 11}" for k in range(3000)) + " " + "x" * 5000 + " end"
    buf = np.frombuffer(text.encode(), np.uint8)
    for n in (1, 2, 4):
        ((count, found),) = resample.features(buf, np.array([0, len(buf)]), n, limit=700)
        assert count == len(tokens(text))
        assert Counter(found.tolist()) == Counter(zlib.crc32(g) for g in grams(text, n))


def test_runs_of_equal_grams_are_one_run():
    ids = np.array([1, 2, 1, 2, 3, 1, 2, 1])
    end = np.array([5] * 5 + [8] * 3)
    order = resample.suffix_order(ids, end, 3)
    found = [tuple(ids[p : min(p + 3, end[p])]) for p in order]
    assert found == sorted(found)
    common = resample.common_words(ids, end, order, 3)
    assert common.tolist() == [0] + [next((d for d in range(3) if a[d : d + 1] != b[d : d + 1] or not a[d : d + 1]), 3) for a, b in zip(found, found[1:], strict=False)]


def test_empty_tables_and_ties(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.resample(empty, empty).count() == 0
    same = docs(spark, [(5, "a b c", "x")] * 4 + [(None, "a b c", "x")] * 2)
    got = resample.resample(same, empty, n=1, percent=100, least_words=1).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5, 6]
    assert len({(r.doc_id, r.weight, r.score) for r in got}) == 2


def test_draws_what_is_like_the_target(spark):
    rows = [(k, " ".join([("good" if k % 5 == 0 else "other") + str(j % 7) for j in range(30)]), "x") for k in range(100)]
    target = spark.createDataFrame([("good1 good2 good3 good4 good5 good6 good0",)], "text string")
    got = resample.resample(docs(spark, rows), target, n=1, percent=20)
    assert {r.doc_id for r in got.collect() if r.rank} == set(range(0, 100, 5))
