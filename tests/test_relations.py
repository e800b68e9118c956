"""Arithmetic, prototype checks, loader facts and reports against plain versions."""

import math
import re

from pyspark.sql import functions as F

from bytequarry.functions import arithmetic, fixed
from bytequarry.operators import bytestats, exports, inventory, records, validate
from bytequarry.plans.catalogue import QUERIES

LEAST = -(1 << 63)
NUMBERS = [LEAST, LEAST + 1, -(1 << 40), -7, -1, 0, 1, 2, 7, 63, 64, 1 << 31, (1 << 63) - 1, None]


def wrap(v):
    return (v - LEAST) % (1 << 64) + LEAST


def test_integers_wrap_around(spark):
    pairs = spark.createDataFrame([(a, b) for a in NUMBERS for b in NUMBERS], "a long, b long")
    ops = {
        "add": lambda a, b: wrap(a + b), "subtract": lambda a, b: wrap(a - b), "multiply": lambda a, b: wrap(a * b),
        "floor_divide": lambda a, b: None if b == 0 else wrap(a // b), "floor_mod": lambda a, b: None if b == 0 else a % b,
        "shift_left": lambda a, b: 0 if abs(b) >= 64 else wrap(a << b) if b >= 0 else wrap(a % (1 << 64) >> -b),
        "shift_right": lambda a, b: 0 if abs(b) >= 64 else wrap(a % (1 << 64) >> b) if b >= 0 else wrap(a << -b),
    }
    rows = pairs.select("a", "b", *(getattr(arithmetic, n)(F.col("a"), F.col("b")).alias(n) for n in ops)).collect()
    for r in rows:
        for n, f in ops.items():
            assert r[n] == (None if r.a is None or r.b is None else f(r.a, r.b)), (n, r.a, r.b)


def test_script_arithmetic_of_large_part_numbers(spark, tmp_path):
    parts = [1, 17, 20_000, 120_001, 1_200_007, 1 << 40]
    rows = spark.createDataFrame([(k, k, p, 61, 3.0) for k, p in enumerate(parts)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: r for r in QUERIES["script_arithmetic"](spark, str(tmp_path)).collect()}
    for k, p in enumerate(parts):
        a = LEAST if p % 17 == 0 else wrap((p * 2654435761 - 3000000000000) * 40503)
        assert (got[k].a, got[k].b, got[k].added, got[k].multiplied) == (a, 21 * 3 * 1000003, wrap(a + 63 * 1000003), wrap(a * 63 * 1000003))


def test_floats(spark):
    nan = math.nan
    rows = spark.createDataFrame([(5.5, 2.0), (-5.5, 2.0), (5.5, -2.0), (1.0, 0.0), (nan, 1.0), (nan, nan), (1e300, 3.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = rows.select(arithmetic.float_mod(a, b).alias("m"), arithmetic.less(a, b).alias("l"), arithmetic.less_equal(a, b).alias("le"), arithmetic.equal(a, b).alias("e")).collect()
    assert [r.m for r in got[:3]] == [1.5, 0.5, -0.5]
    assert math.isnan(got[3].m)
    assert [(r.l, r.le, r.e) for r in got[4:6]] == [(False, False, False)] * 2


def word(name, a=0, b=0, c=0, bx=None):
    return fixed.LUA51.index(name) + a * 64 + (bx * 16384 if bx is not None else c * 16384 + b * 8388608)


def test_checks_of_a_prototype(spark):
    code = [
        word("SETLIST"), word("SETLIST"), word("SETLIST"), word("MOVE", 9),  # 1 and 3 are data
        word("CLOSURE", 0, bx=0), word("MOVE", 0, 7), word("ADD", 0, 1, 1),  # the child takes two words
        word("GETGLOBAL", 0, bx=1), word("JMP", bx=131071 - 8), word("JMP", bx=131071 + 5), 63, word("CLOSURE", 0, bx=0),
    ]
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(code)], "prototype long, pc long, word long")
    protos = spark.createDataFrame([(1, 4, 1, 2, 1, len(code), 3, 0), (2, 4, 1, 2, 1, 0, 0, 0)], "prototype long, max_stack long, upvalues long, n_constants long, n_children long, n_instructions long, n_lines long, n_upvalue_names long")
    constants = spark.createDataFrame([(1, 0, True), (1, 1, False)], "prototype long, index long, is_string boolean")
    children = spark.createDataFrame([(1, 0, 2)], "prototype long, index long, upvalues long")
    decoded = validate.decoded(words)
    assert [r.pc for r in decoded.where("is_data").collect()] == [1, 3]
    rows = validate.words(decoded, protos).union(validate.links(decoded, protos, constants, children)).collect()
    assert {(r.pc, r.code.removeprefix("LUA51_"), r.operand) for r in rows} == {
        (5, "REGISTER_OUT_OF_RANGE", "B"), (6, "INVALID_CLOSURE_BINDING", "pc"), (7, "GLOBAL_NAME_NOT_STRING", "Bx"), (8, "BRANCH_TO_DATA_WORD", "sBx"),
        (9, "BRANCH_OUT_OF_RANGE", "sBx"), (10, "INVALID_OPCODE", "opcode"), (11, "MISSING_CLOSURE_BINDING", "pc"),
    }
    none = words.limit(0)
    assert validate.links(validate.decoded(none), protos, constants, children).count() == 0
    heads = validate.severity(validate.headers(protos, spark.createDataFrame([(1, 0, None, 2, 1)], "prototype long, index long, name string, start_pc long, end_pc long"), spark.createDataFrame([], "prototype long, index long, name string")))
    assert {(r.code, r.severity) for r in heads.collect()} == {("LUA51_DEBUG_LINE_COUNT_MISMATCH", "warning"), ("LUA51_NULL_LOCAL_NAME", "error"), ("LUA51_INVALID_LOCAL_RANGE", "error")}


def test_loader_facts(spark):
    code = "f = function(a) end g=function() m = math . floor n = string t[12] t[12] t[3] t[400] readu8 x:go() x:go() y:stop() f = function ( z ) return setmetatable({}) : run ( ) ;\n"
    rows = spark.createDataFrame([(1, code + "})"), (2, code + "}):start( ) "), (3, "")], "artifact_id long, code string")
    got = {r.artifact_id: r for r in inventory.loader_facts(rows).collect()}
    assert (got[1].functions, got[1].handlers, got[1].aliases, got[1].numeric_keys, got[1].buffer_apis, got[1].entrypoint) == (3, "f,g", "m -> math.floor,n -> string", 2, "readu8", None)
    assert got[2].entrypoint == "start"
    assert (got[3].functions, got[3].handlers, got[3].aliases, got[3].numeric_keys, got[3].entrypoint) == (0, "", "", 0, None)
    assert [(r.method, r.n) for r in inventory.called_methods(rows.where("artifact_id = 1"), 2).orderBy("rank").collect()] == [("go", 2), ("run", 1)]


def test_readable_strings_rank(spark):
    rows = spark.createDataFrame([(1, "zzzz\x01abcd\x02abcd\x03loadstring(x)\x04####\x05" + "q" * 500), (2, None)], "artifact_id long, text string")
    got = [(r.value, r.score) for r in bytestats.readable_strings(rows).orderBy("rank").collect()]
    assert got[0] == ("loadstring(x)", 10_000 + 1_000 + 13 + 11)
    assert got[1] == ("q" * 240, 1_000 + 240 + 240)
    assert got[2:] == [("abcd", 1_008), ("zzzz", 1_008)]


def test_behavior_report_says_what_was_found(spark, sf_dir):
    bodies = {r.artifact_id: r.body for r in QUERIES["behavior_report"](spark, sf_dir).collect()}
    found = QUERIES["capability_inventory"](spark, sf_dir).collect()
    assert len(bodies) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert f"- **{r.category} / {r.api}**: {r.occurrences} occurrence(s); line(s) {re.sub(',', ', ', r.lines)}\n" in bodies[r.artifact_id]
    assert sum(b.count("occurrence(s)") for b in bodies.values()) == len(found)


def test_lines_are_written_in_order(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("line"))
    exports.write_lines(rows.repartition(7), str(tmp_path / "out"), "id")
    files = sorted((tmp_path / "out").glob("*.txt.gz"))
    assert [r.value for f in files for r in spark.read.text(str(f)).collect()] == [f"row {k}" for k in range(1000)]


def test_invariants_and_order(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "name string, value long")
    want = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "name string, value long")
    assert {tuple(r) for r in records.broken_invariants(seen, want).collect()} == {("b", 3, 2), ("c", 4, None)}
    rows = spark.createDataFrame([(1, 5), (1, 2), (1, 9)], "section long, prototype long")
    assert [r.prototype for r in records.root_first(rows, F.col("prototype") == 9).orderBy("place").collect()] == [9, 2, 5]


def test_payload_facts_and_known_profiles(spark):
    from bytequarry.operators import payloads

    rows = [(1, b"\x1bLuaQ\x00"), (2, b"\x00ab"), (3, b"\xff"), (4, b"\xef\xbb\xbf" + b"a" * 100), (5, b"a" * 97 + b"\x01" * 3), (6, b""), (7, None), (8, "\U0001f600".encode() * 9), (9, b"a" * 98 + b"\x01" * 2)]
    got = {r.artifact_id: r for r in payloads.payload_facts(spark.createDataFrame(rows, "artifact_id long, content binary")).collect()}
    assert [k for k, r in got.items() if r.lua51] == [1] and [k for k, r in got.items() if r.raw_lzma] == [2]
    assert {k for k, r in got.items() if r.media_type.startswith("text")} == {4, 9}
    assert got[4].head == "efbbbf" + "61" * 29 and (got[7].head, got[7].n_bytes) == ("", 0)
    pairs = "id int, loader_sha256 string, payload_sha256 string"
    found = payloads.known_profiles(spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", "c"), (3, None, "b")], pairs), spark.createDataFrame([(9, "a", "b"), (9, "a", "b"), (9, None, "b")], pairs))
    assert sorted(r.id for r in found.collect()) == [1, 1]


def test_structural_coherence(spark):
    from pyspark.sql import functions as F

    from bytequarry.operators import records

    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (11, 1), (21, 1), (31, 1)], "prototype long, pc long")
    refs = spark.createDataFrame([("constant", 11, False), ("prototype", 21, False), ("constant", 1, True), ("constant", 41, False)], "kind string, prototype long, found boolean")
    got = {r.section: (r.prototypes, r.instructions, r.coherent) for r in records.structural_coherence(rows, refs, F.floor(F.col("prototype") / 10), F.when(F.col("section") == 3, 2).otherwise(1)).collect()}
    assert got == {0: (2, 3, True), 1: (1, 1, False), 2: (1, 1, False), 3: (1, 1, False), 4: (0, 0, False)}
