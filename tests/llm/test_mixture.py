import random
import re

import pytest

from bytequarry.llm import mixture
from tests.compare import assert_same, connect
from tests.llm.helpers import SCHEMA, awkward, docs


def test_equals_sql(spark, sf_dir):
    from bytequarry.llm.queries import op2_pareto_mixture

    got = op2_pareto_mixture(spark, sf_dir)
    assert_same(got.toPandas(), connect(sf_dir).execute(mixture.MIX_SQL.format(docs="documents")).df())


def levels(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return {**{s: left * weight[s] / total for s in open_}, **fixed}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("tiny", [False, True])
def test_targets_copies_and_columns(spark, tiny):
    rows = awkward() + [(400 + k, "few words here", None) for k in range(3)] + [(600, None, "empty")]
    if tiny:
        rows = [r for r in rows if r[2] != "b"] + [(900, "one", "b"), (901, "two", "B")]
    table = docs(spark, rows, clash=True)
    mixed = mixture.mix(table)
    assert mixed.columns == [*table.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    got = mixed.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = levels(sizes)
    for r in got:
        assert r.mix_size == size(r.text)
        assert r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source])
        assert 0 <= r.mix_copies <= 3
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.mix_size * r.mix_copies for r in own) - want[s]) <= 2 * max(r.mix_size for r in own)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixture.mix(table.repartition(7)).collect()))
    taken = mixture.take(mixed)
    assert taken.columns == table.columns
    assert taken.count() == sum(r.mix_copies for r in got)


def plain_odds(sizes, rest):
    """Inclusion probabilities in proportion to size classes, at most 1, by raising one after the other to 1."""
    measure = [1 << (n.bit_length() - 1) if n else 0 for n in sizes]
    certain = set()
    while True:
        left = rest - sum(sizes[i] for i in certain)
        level = left / sum(n * m for i, (n, m) in enumerate(zip(sizes, measure)) if i not in certain)
        over = {i for i, m in enumerate(measure) if i not in certain and level * m > 1}
        if not over:
            return [1.0 if i in certain else level * m for i, m in enumerate(measure)]
        certain |= over


def test_inclusion_is_by_size_and_expects_the_rest(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 3, 5, 9, 20, 40, 300, 1500]) for _ in range(60)] + [0]
    rows = [("a", n, n.bit_length()) for n in sizes]
    table = spark.createDataFrame(rows, "source string, size long, class int")
    for share in (0.0, 0.2, 0.9, 0.99):
        rest = share * sum(sizes)
        plan = spark.createDataFrame([("a", rest)], "source string, rest double")
        odds = mixture.inclusion(table, plan).first().odds
        want = plain_odds(sizes, rest)
        assert [odds.get(n.bit_length(), 0.0) for n in sizes] == pytest.approx(want)
        assert sum(n * p for n, p in zip(sizes, want)) == pytest.approx(rest)


def test_documents_are_taken_as_often_as_their_inclusion_probability_says(spark):
    """Over many seeds; and the words taken are the target's each time, within half a document of the ranks' edge."""
    rng = random.Random(3)
    rows = [(k, "w " * rng.choice([2, 4, 8, 64]), "ab"[k % 2]) for k in range(60)]
    table, times, runs = docs(spark, rows).cache(), {}, 12
    for seed in range(runs):
        got = mixture.mix(table, seed=seed).select("doc_id", "source", "mix_size", "mix_copies", "mix_target", "mix_source_size").collect()
        for r in got:
            times[r.doc_id] = times.get(r.doc_id, 0) + r.mix_copies
        for s in "ab":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.mix_size * r.mix_copies for r in own) - own[0].mix_target) <= 32
    for s in "ab":
        own = [r for r in got if r.source == s]
        whole, rest = divmod(own[0].mix_target, own[0].mix_source_size)
        want = plain_odds([r.mix_size for r in own], rest)
        for r, p in zip(own, want):
            assert abs(times[r.doc_id] / runs - whole - p) <= 0.08 + 4 * (p * (1 - p) / runs) ** 0.5


def test_empty(spark):
    assert mixture.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = docs(spark, [(1, None, "a"), (2, "", None)])
    assert {(r.mix_target, r.mix_copies) for r in mixture.mix(blank).collect()} == {(0.0, 0)}
