import collections
import hashlib
import os
import random

import numpy as np
import pytest

from bytequarry.llm import suffix
from tests.llm.helpers import SCHEMA, awkward, docs


def brute(texts, n):
    data, seen, out = [(t or "").encode() for t in texts], collections.Counter(), []
    for b in data:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, n, clash=False):
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in suffix.remove_repeats(docs(spark, rows, clash).repartition(3), n).collect()}
    want = brute(texts, n)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == w[3]
        assert sum(s.hi - s.lo for s in r.removed) == r.n_removed


@pytest.mark.parametrize("n", [16, 32])
def test_equals_brute_force(spark, n):
    rng = random.Random(n)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 60))) for _ in range(12)]
    texts = [None, "", "a" * 100, "ab" * 70, "ab" * 70, "abc" * 50]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += ["".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 9))) for _ in range(60)]
    check(spark, texts, n, clash=n == 16)


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", 2)
    test_equals_brute_force(spark, 16)
    test_equals_brute_force(spark, 32)


def test_a_passage_in_very_many_texts_is_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", 4)
    called, counting = [], suffix.repeated_strings
    monkeypatch.setattr(suffix, "repeated_strings", lambda *a: called.append(1) or counting(*a))
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(90)
    texts = [word(rng.randint(0, 60)) + passage[rng.randint(0, 9) : rng.randint(70, 90)] + word(rng.randint(0, 60)) for _ in range(80)]
    check(spark, [*texts, None, "", *texts[:5]], 32)
    assert called


def test_long_documents_are_looked_at_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    monkeypatch.setattr(suffix, "PART_BYTES", 700)
    for n in (16, 64):
        whole = suffix.anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), n)
        batch = __import__("pyarrow").RecordBatch.from_pydict({"k": [b"k"], "t": [text]})
        (got,) = list(suffix._anchors(n)([batch]))
        assert set(zip(*(x.tolist() for x in whole[1:]))) <= set(zip(got["pos"].to_pylist(), got["code"].to_pylist(), got["context"].to_pylist()))


def test_awkward_and_empty(spark):
    rows = awkward()
    got = suffix.remove_repeats(docs(spark, rows), 400).collect()
    assert len(got) == len(rows)
    assert {r.n_removed == r.n_bytes for r in got if r.doc_id in (4, 5)} == {True}
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="multiple of 8"):
        suffix.remove_repeats(docs(spark, rows), 20)


def test_two_stage_order_and_common_prefixes():
    rng = random.Random(1)
    for trial in range(200):
        parts = [bytes(rng.choice(b"ab" if trial % 2 else b"aab c") for _ in range(rng.randint(16, 60))) for _ in range(rng.randint(1, 6))]
        if trial % 3 == 0:
            parts = [b"a" * rng.randint(16, 40), *parts]
        data, valid, at = b"".join(parts), [], 0
        for p in parts:
            valid += range(at, at + len(p) - 15)
            at += len(p)
        order = suffix.suffix_order(data, np.array(valid), 16)
        keys = [data[i : i + 16] for i in order]
        assert sorted(order.tolist()) == valid
        assert keys == sorted(keys)
        common = suffix.adjacent_common(data, order, 16)
        assert common[1:].tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(keys, keys[1:])]
