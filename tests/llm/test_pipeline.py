import re

import numpy as np

import corpus_pipeline
from bytequarry.llm import pii
from bytequarry.llm.queries import QUERIES
from tests.llm.helpers import awkward
from tests.llm.helpers import docs as docs_of
from tests.llm.test_neardup import brute
from tests.llm.test_pii import plain_bootstrap
from tests.llm.test_tokens import plain  # noqa: F401


def test_stages_against_plain_versions(spark, sf_dir, plain):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, found = docs.collect(), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(seen, docs.schema), sf_dir)
        found.append((seen, rows := out.collect()))
        if out.columns == docs.columns:
            seen = rows
    (a, quality), (b, unique), (c, masked), (d, mixed), (e, pieces) = found
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r.doc_id for r in quality} <= {r.doc_id for r in a}
    assert np.mean([labels[r.doc_id] for r in quality if r.doc_id in labels]) > 0.97
    assert sum(labels[r.doc_id] for r in quality if r.doc_id in labels) >= 0.98 * sum(labels.values())
    group = {i: g for i, _, g in brute([(r.doc_id, r.text, None) for r in b], 5)}
    blank = {r.doc_id for r in b if not re.search(r"[^\x20\x09-\x0D]", r.text or "")}
    assert sorted(r.doc_id for r in unique) == sorted(i for i, g in group.items() if i == g or i in blank)
    adopted, _ = plain_bootstrap([r.text for r in c])
    sizes = set(range(1, 20))
    for old, new in zip(sorted(c), sorted(masked)):
        assert old.doc_id == new.doc_id
        places = pii.occurrences(old.text, pii.base_spans(old.text), sizes)
        added = [{"kind": adopted[old.text[x:y]], "start": x, "end": y} for x, y, short in places if not short and old.text[x:y] in adopted]
        assert new.text == pii._masked(old.text, added)
        assert new.n_chars == len(new.text)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert abs(sum(size(r.text) for r in mixed) - sum(size(r.text) for r in d)) < 0.1 * sum(size(r.text) for r in d)
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in d}
    assert sum(r.length for r in pieces) == sum(len(plain(r.text)) for r in e)


def test_run_equals_its_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    rows = awkward()
    for table in (docs_of(spark, rows, clash=True), docs_of(spark, rows).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, sf_dir).collect()
            if not table.limit(1).count():
                assert found == [], name
            elif name == "near-duplicates":
                assert sorted((r.doc_id or 0) for r in found if r.doc_id in (4, 5, 6)) == [4]
                assert {r.doc_id for r in found} >= {None, 1, 2, 3, 7, 8}
            elif name == "packing":
                assert sorted({r.doc_id for r in found}, key=str) == sorted({r[0] for r in rows}, key=str)
            elif name == "personal data":
                assert sorted(((r.doc_id, r.text or "") for r in found), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
            else:
                assert {(r.doc_id, r.text) for r in found} <= {(r[0], r[1]) for r in rows}, name


def test_every_operator_is_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(k) for k in range(1, 14)]
