"""Folding of joined literals: cases, the invariants of what stays, and random expressions with known values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import fixed, text
from bytequarry.operators import folding

CASES = {
    'v = ("A" .. "\\000") .. "\\255"\nreturn v': 'v = "A\\000\\255"\nreturn v',
    'return "\\195\\169" .. "\\255"': 'return "\\195\\169\\255"',
    'return "é" .. \'x"\'': 'return "\\195\\169x\\""',
    'return [[a]] .. "b"': None,
    'return [[a]] .. "b" .. "c"': 'return [[a]] .. "bc"',
    'return "a" -- evidence\n  .. "b"': None,
    'return "a" -- evidence\n  .. "b" .. "c"': None,
    'return ("a" .. "b") .. effect()': 'return ("ab") .. effect()',
    'return "a" .. "b" .. effect()': None,
    'return effect("p" .. "q", 1) .. "a" .. "b"': 'return effect("pq", 1) .. "ab"',
    'return "\\"" .. "\\\\"': 'return "\\"\\\\"',
    'return "\\001" .. "2"': 'return "\\0012"',
    'return #"a" .. "b"': None,
    'return #"a" .. "b" .. "c"': 'return #"a" .. "bc"',
    'return 1 + "2" .. "3" .. "4"': 'return 1 + "2" .. "34"',
    'return "1" .. "2" + 3': None,
    'return "a" .. "2" ^ 3': None,
    'return "a" .. "b" == x .. "c" .. "d"': 'return "ab" == x .. "cd"',
    'return ("a" .. "b"):rep(2)': 'return ("ab"):rep(2)',
    'return "x" .. ("a" .. "b"):rep(2)': 'return "x" .. ("ab"):rep(2)',
    'f "a" .. "b"': None,
    'x = f "a" .. "b" .. "c"': 'x = f "a" .. "bc"',
    'x = f("a") .. ("b" .. "c")': 'x = f("a") .. ("bc")',
    'x = "a" .. ("b" .. ("c")) y = {"d" .. "e", [ "k" .. "l" ] = 1}': 'x = "abc" y = {"de", [ "kl" ] = 1}',
    'x = "a" .. "b"\n(f)()': 'x = "ab"\n(f)()',
    'x = "a" .. "\\q" .. "b" .. "c"': 'x = "a" .. "\\q" .. "bc"',
    'x = "a" .. "\\300"': None,
    'x = "a" .. "b\\\n"': None,
    'x = ("a" .. y) .. "b" .. "c"': 'x = ("a" .. y) .. "bc"',
    'x = ("a" == "b" .. "c") .. "d" .. "e"': 'x = ("a" == "bc") .. "de"',
    'x ..= "a" .. "b" z = ... .. "c" .. "d"': 'x ..= "ab" z = ... .. "cd"',
    'x = (("a")) .. (("b" .. "c"))': 'x = "abc"',
    '-- "a" .. "b"\nx = [[ "a" .. "b" ]]': None,
    'x = ("a" .. "b"': "unbalanced",
    'x = "a" .. "b"}': "unbalanced",
    "": None,
}


def after(source):
    edits, status, out = folding._folded(source)
    return status if status not in ("folded", "none") else out if edits else None


@pytest.mark.parametrize("source", CASES)
def test_case(source):
    assert after(source) == CASES[source]


def test_limits(monkeypatch):
    half = "x" * (fixed.FOLDED_BYTES // 2)
    assert after(f'v = "{half}" .. "{half}"') == f'v = "{half}{half}"'
    assert after(f'v = "y" .. "{half}" .. "{half}"') == f'v = "y" .. "{half}{half}"'
    assert after(f'v = ("{half}" .. "{half}") .. "y" .. "z"') == f'v = ("{half}{half}") .. "yz"'
    one = 'v = "a" .. "b" '
    assert after(one * fixed.FOLD_EDITS).count('"ab"') == fixed.FOLD_EDITS and after(one * (fixed.FOLD_EDITS + 1)) == "edit-limit"
    monkeypatch.setattr(fixed, "FOLD_OUTPUT", 7)
    assert after(one) == 'v = "ab" ' and after(one * 2) == "output-limit"


def test_without_limits_all_folds():
    half = "x" * (fixed.FOLDED_BYTES // 2)
    assert folding._folded(f't = {{("y{half}" .. "{half}").."!"}}', limited=False)[2] == f't = {{"y{half}{half}!"}}'
    one = 'v = "a" .. "b" '
    assert folding._folded(one * (fixed.FOLD_EDITS + 1), limited=False)[1:] == ("folded", 'v = "ab" ' * (fixed.FOLD_EDITS + 1))


def test_random_expressions_keep_their_value():
    rng = random.Random(3)

    def expression(depth):
        parts, value, pure = [], b"", True
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["literal", "literal", "group", "name"]) if depth else "literal"
            if kind == "group":
                inner, v, p = expression(depth - 1)
                parts.append(f"({inner})")
            elif kind == "name":
                parts.append("n")
                v, p = b"", False
            else:
                v, p = bytes(rng.choice([0, 7, 34, 39, 48, 92, 97, 195, 255]) for _ in range(rng.randint(0, 3))), True
                parts.append(folding.literal(v))
            value, pure = value + v, pure and p
        return rng.choice([" .. ", "..", "\n..\t"]).join(parts), value, pure

    seen = 0
    for _ in range(3000):
        source, value, pure = expression(3)
        out = folding._folded(f"v = {source}")[2]
        if pure:
            seen += 1
            assert folding.literal_bytes(re.sub(r"[()]", "", out.removeprefix("v = ")).strip()) == value
        # names, and the text of all literals one after the other, stay in their order
        said = lambda s: [folding.literal_bytes(t) if t[0] == '"' else b"<n>" for t in re.findall(r'"(?:[^"\\]|\\[\s\S])*"|n', s)]
        assert b"".join(said(out)) == b"".join(said(f"v = {source}"))
        assert folding._folded(out)[0] == []
    assert seen > 300


def test_rows(spark):
    rows = spark.createDataFrame([(k, s, "x") for k, s in enumerate([*CASES, None])], "artifact_id long, text string, _fold string").withColumnRenamed("_fold", "edit")
    got = folding.fold(rows).cache()
    by = {r.text: r for r in got.collect()}
    for source, want in CASES.items():
        r = by[source]
        assert (r.folded if r.edits else r.fold_status if r.fold_status == "unbalanced" else None) == want
    assert by[None].folded is None and by[None].edits == []
    # outside of edits, what is code stays: masking again gives the same
    blank = "aggregate(edits, text, (t, e) -> overlay(t placing repeat(' ', int(e.end - e.start)) from int(e.start + 1) for int(e.end - e.start)))"
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    same = got.where("text is not null").select((squeeze(text.masked(F.expr(blank))) == squeeze(text.masked(F.col("folded")))).alias("same"))
    assert all(r.same for r in same.collect())
    edits = folding.edit_rows(got).collect()
    assert len(edits) == sum(len(r.edits) for r in by.values())
    assert folding.fold(rows.limit(0)).count() == 0
