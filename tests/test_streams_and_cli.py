"""Stream pairs against a plain reader, scratch folders, and the command line."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from bytequarry.__main__ import main
from bytequarry.functions import fixed
from bytequarry.operators import streams
from bytequarry.plans import tables


def encode(data, little):
    out = ""
    for k in range(0, len(data), 4):
        v = int.from_bytes(data[k : k + 4], "little" if little else "big")
        out += "".join(chr(33 + v // 85**p % 85) for p in (4, 3, 2, 1, 0))
    return out


def decode(text, little):
    data, k = b"", 0
    while k < len(text):
        if text[k] == "z":
            data, k = data + bytes(4), k + 1
            continue
        group = text[k : k + 5]
        if len(group) < 5 or any(not 33 <= ord(c) <= 117 for c in group):
            return None
        v = 0
        for c in group:
            v = v * 85 + ord(c) - 33
        if v >= 1 << 32:
            return None
        data, k = data + v.to_bytes(4, "little" if little else "big"), k + 5
    return data or None


def escape(text, rng):
    return "".join(f"\\{ord(c):03d}" if k > 3 and (c in "\\\"'" or rng.random() < 0.1) else c for k, c in enumerate(text))


def literal(text, rng):
    kind = rng.choice(["long", "double", "single"])
    if kind == "long" and "]]" not in text and "]=]" not in text and not text.endswith("]"):
        e = "=" * rng.choice([0, 1, 3])
        if f"]{e}]" not in text:
            return f"[{e}[{text}]{e}]"
    q = '"' if kind == "double" else "'"
    return q + escape(text, rng) + q


def test_pairs_and_their_one_reading(spark):
    rng, rows, want_pairs, want = random.Random(7), [], {}, {}
    for k in range(150):
        n, little, skip = rng.choice([1, 2, 2, 2, 3]), rng.random() < 0.5, rng.choice([4, 9, 14, 19, 6])
        found = []
        for i in range(n):
            data = (b"\0" if i == 0 and rng.random() < 0.8 else b"\7") + rng.randbytes(rng.choice([3, 7, 11]))
            body = "LPH@" + "V" * (skip - 4) + encode(data, little) + ("z" if rng.random() < 0.2 else "") + ("x" if rng.random() < 0.1 else "")
            found.append((body, rng.choice([None, skip + 1, 0, 12345]) if i == 0 or rng.random() < 0.3 else None))
        rows.append((k, "local V,y=" + ",".join(f"Y({literal(b, rng)}{'' if d is None else f' , {d} '})" for b, d in found) + " -- LPH"))
        found = [(b, d if d is None or d < 10000 else None) for b, d in found]
        if n >= 2:
            want_pairs[k] = found
            d = found[0][1]
            for s, lit in ((s, lit) for s in dict.fromkeys([*([d - 1] if d is not None and d >= 1 else []), *fixed.STREAM_SKIPS]) for lit in (True, False)):
                data = [decode(b[s:], lit) if len(b) > s else None for b, _ in found]
                if all(data) and data[0][0] == 0:
                    want[k] = (n, s, lit, data)
                    break
    pairs = streams.stream_pairs(spark.createDataFrame(rows, "artifact_id long, text string")).cache()
    assert {r.artifact_id: [(s.text, s.declared) for s in r.streams] for r in pairs.collect()} == want_pairs
    assert {r.artifact_id: (r.streams, r.skip, r.little, [bytes(d) for d in r.data]) for r in streams.accepted_pairs(pairs).collect()} == want
    assert streams.stream_pairs(spark.createDataFrame([(1, None), (2, "")], "artifact_id long, text string")).count() == 0


def test_unescaped(spark):
    cases = {r"a\110b": "anb", r"\\n": r"\n", r"\n\t\"\'": "\n\t\"'", r"\0651": "A1", "plain": "plain", "\\\n": "\n", r"\q": "q", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", streams.unescaped(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases


def test_escapes_are_text_for_streams_and_bytes_for_folding():
    assert all(isinstance(v, str) for v in fixed.ESCAPES.values())
    assert {k: ord(v) for k, v in fixed.ESCAPES.items()} == {k: v for k, v in fixed.ESCAPE_BYTES.items() if k.isalpha()}


def test_scratch_is_deleted_and_nests(spark):
    with tables.scratch(spark) as folder:
        outer = tables.written(spark.range(3).toDF("a"), "x")
        with tables.scratch(spark) as inner:
            assert tables.written(outer, "y").count() == 3
            assert inner.startswith(folder) and os.path.isdir(inner.removeprefix("file:"))
        assert not os.path.isdir(inner.removeprefix("file:")) and outer.count() == 3
    assert not os.path.isdir(folder.removeprefix("file:"))
    with pytest.raises(ValueError), tables.scratch(spark) as folder:
        tables.written(spark.range(3).toDF("a"), "x")
        raise ValueError
    assert not os.path.isdir(folder.removeprefix("file:"))


def run(spark, *args):
    out = io.StringIO()
    return main(list(args), spark, out), [json.loads(x) for x in out.getvalue().splitlines()]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "in" / "a.lua").write_text("local x = 1\nif x then return loadstring('y') end\n")
    (tmp_path / "in" / "b.TXT").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "in" / "c.exe").write_bytes(b"not read")
    status, rows = run(spark, "detect", str(tmp_path / "in"))
    assert status == 0
    assert {r["file_name"]: (r["kind"], r["selection"]["plugin_id"], len(r["detections"])) for r in rows} == {"a.lua": ("lua-source", "generic-static", 4), "b.TXT": ("binary", "generic-static", 4)}
    status, rows = run(spark, "analyze", str(tmp_path / "in"), "--out", str(tmp_path / "out"))
    assert status == 0
    assert sorted((r["file_name"], r["role"]) for r in rows if r["artifact_id"].endswith("a.lua")) == [("a.lua", "original"), ("behavior.txt", "behavior"), ("report.json", "report")]
    assert run(spark, "detect", str(tmp_path / "empty"))[0] == 1
    status, rows = run(spark, "plugins")
    assert status == 0 and [r["plugin_id"] for r in rows] == sorted(fixed.BASES)
    with pytest.raises(SystemExit):
        run(spark, "unknown")
