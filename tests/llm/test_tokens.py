import zlib

import numpy as np
import pytest

from bytequarry.llm import tokens
from bytequarry.llm.queries import tokenizer_path
from tests.llm.helpers import SCHEMA, awkward, docs

TEXTS = ["It's 12 o'clock, isn't IT?", "Straße ÄÖÜ İstanbul ΣΑΣ é́ é", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd\x0be\rf", "日本語 テキスト", "x" * 3000, "﻿bom ', 's", "a  b\n\n c", "½ ² ٣ 10"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def test_cached_ids_equal_the_tokenizers(plain, spark, sf_dir):
    table = tokens.WordIds(tokenizer_path())
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts * 2:
        assert np.frombuffer(table.ids(text), "<u4").tolist() == plain(text)[:-1]


@pytest.mark.parametrize("length", [7, 64])
def test_concatenate_and_cut(spark, plain, length):
    rows = awkward() + [(500 + k, t, "a") for k, t in enumerate(TEXTS)]
    table = docs(spark, rows, clash=True).repartition(3).cache()
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(plain(t))
    pieces = tokens.concatenate_and_cut(table, tokenizer_path(), 2, length)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    total = sum(len(x) for v in ids.values() for x in v)
    at = 0
    for r in got:
        assert r.sequence_id * length + r.offset == at
        assert r.offset + r.length <= length
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        at += r.length
    assert at == total
    full = tokens.sequences(pieces, length, 9).collect()
    assert sum(r.cu_seqlens[-1] for r in full) == total
    for r in full:
        assert len(r.ids) == length
        assert set(r.ids[r.cu_seqlens[-1] :]) <= {9}
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert list(r.position_ids[a:b]) == list(range(b - a))


def test_best_fit_rows_hold_every_id_once(spark, plain):
    rows = awkward() + [(500 + k, t, "a") for k, t in enumerate(TEXTS)]
    got = tokens.best_fit_packing(docs(spark, rows, clash=True), tokenizer_path(), 2, 64, block_tokens=2000, pad_id=5).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    found, want = [], []
    for r in got:
        row, positions = (np.frombuffer(x, f"<u{r.id_bytes}").tolist() for x in (r.ids, r.position_ids))
        assert len(row) == len(positions) == 64
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found.append((doc, start, tuple(row[a:b])))
            assert positions[a:b] == list(range(b - a))
        assert set(row[r.cu_seqlens[-1] :]) <= {5}
    for i, t, _ in rows:
        x = plain(t)
        want += [(i, k, tuple(x[k : k + 64])) for k in range(0, len(x), 64)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_segment_tree_finds_the_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(1, 65, 60).tolist()
        bins = tokens.best_fit_decreasing(lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
        slow: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, left in enumerate(slow) if left >= n]
            if fits:
                slow[min(fits, key=lambda k: slow[k])] -= n
            else:
                slow.append(64 - n)
        assert len(bins) == len(slow)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.concatenate_and_cut(empty, tokenizer_path()).count() == 0
    assert tokens.best_fit_packing(empty, tokenizer_path()).count() == 0
