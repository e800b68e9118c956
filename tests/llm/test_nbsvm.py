import random

import numpy as np

from bytequarry.llm import nbsvm
from tests.llm.helpers import SCHEMA, awkward, docs

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=0):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["the", "and", "river", "stone", "walks", "over", "green."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["the", "and", "river", "stone"]) + rng.choice(["***", "###"]) for _ in range(40))
    return [(k, good() if k % 3 else bad(), "a") for k in range(300)]


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _, _ in rows] + [(1, None, 0), (2, 7, 0)], LABELS)
    table = docs(spark, rows + awkward(), clash=True)
    out = nbsvm.classify(table, labels)
    assert out.columns == [*table.columns, "held_out", "quality_score", "quality_predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(awkward())
    mine = [r for r in got if r.doc_id is not None and r.text in {t for _, t, _ in rows}]
    assert any(r.held_out for r in mine)
    assert all((r.quality_predicted == 1) == (r.doc_id % 3 > 0) for r in mine)
    assert all(0 <= r.quality_score <= 1 and r.quality_predicted == int(r.quality_score >= 0.3) for r in got)
    assert len({r.quality_score for r in got if not (r.text or "").strip()}) == 1


def test_held_out_accuracy(spark, sf_dir):
    from bytequarry.llm.queries import op8_quality

    got = op8_quality(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.quality_score for r in nbsvm.classify(docs(spark, corpus()), none).collect()} == {0.5}
    assert nbsvm.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_solution_is_optimal():
    """No small change of the weights lowers the objective that the dual steps minimise."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(40)]
    y = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    scale, cost = rng.normal(1, 0.2, 20), np.full(40, 0.7)
    w = nbsvm.dual_coordinate_descent(rows, scale, y, cost, epochs=400)
    x = np.zeros((40, 21))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
        x[i, 20] = 1
    objective = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - y * (x @ v))
    best = objective(w)
    assert all(objective(w + rng.normal(0, 1e-2, 21)) > best - 1e-4 for _ in range(300))


def test_counts_and_scores_equal_plain_ones(spark):
    """Log-count ratios from plain counts over all training rows, and every score from the model's numbers one by one."""
    import math

    rows = corpus(1)
    table = docs(spark, rows + awkward())
    model = nbsvm.fit(docs(spark, rows).selectExpr("text", "doc_id", "int(doc_id % 3 > 0) as label").repartition(5))

    def plain(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        (found,) = nbsvm.features(data, np.array([0, len(data)]))
        return found.tolist()

    seen, met = [0, 0], {}
    for i, text, _ in rows:
        y = int(i % 3 > 0)
        seen[y] += 1
        for f in plain(text):
            met.setdefault(f, [0, 0])[y] += 1
    ratio = lambda f: math.log(((met.get(f, (0, 0))[1] + 1) / (seen[1] + 2)) / ((met.get(f, (0, 0))[0] + 1) / (seen[0] + 2)))
    assert all(abs(model.scale2[f] - ratio(f) ** 2) < 1e-9 for f in range(0, 1 << nbsvm.FEATURE_BITS, 7))
    assert all(abs(model.scale2[f] - ratio(f) ** 2) < 1e-9 for f in met)
    for r in table.select("text", nbsvm.score(table, model).alias("s")).collect():
        found = plain(r.text)
        norm = math.sqrt(sum(ratio(f) ** 2 for f in found))
        margin = sum(model.weight[f] for f in found) / max(norm, 1e-9) + model.bias
        assert abs(r.s - 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.offset))))) < 1e-4
