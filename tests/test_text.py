import random
import re

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import fixed
from bytequarry.functions import text as text_functions
from bytequarry.functions.text import control_share, count, masked, physical_lines
from bytequarry.operators import audit, bytestats, chunk, flowtree, graph, inventory, records, streams
from bytequarry.operators import classify as C
from bytequarry.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""),
        ("a -- b\nc", "a     \nc"),
        ('x = "a\nb" y', "x =   \n   y"),
        ("s = 'it\\'s' z", "s =         z"),
        ("--[[ a\nb ]] c", "      \n     c"),
        ("--[==[ ]] ]==] c", "               c"),
        ("t = [=[ load ]=] u", "t =              u"),
        ("a[b[1]] = 2 - 1", "a[b[1]] = 2 - 1"),
        ('open "never closed', "open              "),
        ("`load` kept", "`load` kept"),
    ],
)
def test_mask_keeps_places(spark, text, want):
    got = one(spark, text, masked)
    assert got == want
    assert len(got) == len(text)


def test_long_strings_do_not_overflow(spark):
    for text in ("x = '" + "\\'" * 500_000 + "' y", 'x = "' + "a\\n" * 500_000 + '" y', "x = [[" + "a]" * 500_000 + "a]] y"):
        assert one(spark, text, masked).strip().split() == ["x", "=", "y"]


def scanned(text):
    """Masking by a plain scanner."""
    out, at = [], 0
    while at < len(text):
        end = None
        bracket = lambda k: re.compile(r"\[(=*)\[").match(text, k)
        long = bracket(at + 2) if text.startswith("--", at) else bracket(at)
        if long:
            close = text.find(f"]{long[1]}]", long.end())
            end = len(text) if close < 0 else close + len(long[1]) + 2
        elif text.startswith("--", at):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
        elif text[at] in "\"'":
            end = at + 1
            while end < len(text) and text[end] != text[at]:
                end += 2 if text[end] == "\\" else 1
            end = min(len(text), end + 1)
        out.append(text[at] if end is None else re.sub(r"[^\r\n]", " ", text[at:end]))
        at = at + 1 if end is None else end
    return "".join(out)


def test_masking_equals_a_plain_scanner(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["\\", '"', "'", "[", "[[", "]]", "[=[", "]=]", "=", "--", "\n", "\r", "a", "load", " ", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += ['x \\"load" z', "[==[ ]] ]=] ]==] a", "--[=[ \\]=] a", "'\\", "[[\\]] a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masked(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.m == scanned(r.t), r.t


def test_boundaries_equal_general_ones(spark):
    """The shorter looks that java() writes match as two-sided boundaries do."""
    words = "0x1f load request syn.request debug . getinfo :HttpGet x_load load_ éload L1_2 A1_2b goto L3 MoonSec V3 MoonSec while do local if function ".split()
    rng = random.Random(2)
    texts = [("".join(rng.choice([*words, " ", " ", ".", "=", "é", "1", "_"]) for _ in range(rng.randint(1, 12))),) for _ in range(300)]
    rows = spark.createDataFrame(texts, "t string")
    patterns = [p for *_, p in fixed.CAPABILITIES] + [p for _, p, _ in fixed.AUDIT_SIGNALS] + [p for _, p in fixed.LUAU_SIGNALS] + [p for *_, p in fixed.COUNTS] + [fixed.STATEMENTS, fixed.REGISTERS, fixed.CALLS, fixed.GOTO]
    got = rows.select("t", *(count(F.col("t"), p).alias(f"c{k}") for k, p in enumerate(patterns))).collect()
    for k, p in enumerate(patterns):
        plain = re.compile(p.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"), re.A)
        for r in got:
            assert r[f"c{k}"] == len(plain.findall(r.t)), (p, r.t)


def test_self_calls_equal_plain_ones(spark, sf_dir):
    from bytequarry.plans import catalogue, views

    name, pattern = fixed.HAZARDS[-1]
    want = {}
    for r in views.programs(spark, sf_dir).select("artifact_id", "text").collect():
        n = sum(1 for _ in re.finditer(pattern, scanned(r.text), re.A))
        if n:
            want[r.artifact_id] = n
    got = {r.artifact_id: r.occurrences for r in catalogue.hazard_self_calls(spark, sf_dir).collect()}
    assert got == want
    assert len(got) > 50


def test_route_in_the_row_equals_the_relation(spark):
    text = "-- Luraph\nMoonSec V3 " + "n=(n+0x1f)%0x1f9; while x do " * 40
    counted = C.counts(C.classify(artifacts(spark, [(1, "a.lua", text, False), (2, "b.txt", "plain", False), (3, "c", None, False)])))
    want = {r.artifact_id: tuple(r)[1:] for r in C.select_route(C.detect(counted)).collect()}
    got = {r.artifact_id: (r.plugin_id, r.ambiguous, r.first_id, r.first_confidence, r.margin) for r in C.with_route(counted).collect()}
    assert got == want


def test_words_end_at_ascii_boundaries(spark):
    assert one(spark, "éload load xload", lambda t: count(t, r"\bload\b")) == 2


def test_lines_and_controls(spark):
    assert one(spark, "", physical_lines) == 0
    assert one(spark, "a\n", physical_lines) == 2
    assert one(spark, "\x01\x02ab", control_share) == 0.5


def artifacts(spark, rows):
    return spark.createDataFrame(rows, "artifact_id long, file_name string, text string, is_bytecode boolean")


def test_classifier_rules_in_order(spark):
    audit_text = "\n".join(["-- stack slots: 1; decoded instructions: 2", *(f"::L{k}:: goto L{k}" for k in range(9)), "VM_FRAGMENT"])
    rows = [
        (1, "a.luac", None, True), (2, "b.bin", None, False), (3, "c.lua", "\x00", False), (4, "d.txt", audit_text, False), (5, "e.luau", "x", False),
        (6, "f.lua", "local x return", False), (7, "g.txt", "local function f() end", False), (8, "h.txt", "plain words", False), (9, "i.txt", "x += 1", False), (10, None, None, None),
    ]
    got = {r.artifact_id: (r.kind, r.confidence) for r in C.classify(artifacts(spark, rows)).collect()}
    assert got[1] == ("lua-bytecode", 1.0)
    assert got[2] == ("binary", 0.98)
    assert got[3] == ("binary", 0.9)
    assert got[4] == ("vm-audit-ir", 0.89)
    assert got[5] == ("luau-source", 0.62)
    assert got[6] == ("lua-source", 0.92)
    assert got[7] == ("lua-source", 0.7)
    assert got[8] == ("text", 0.7)
    assert got[9] == ("luau-source", 0.88)
    assert got[10] == ("binary", 0.98)


def test_selection_needs_a_margin(spark):
    rows = [(1, "vm-audit", 0.9), (1, "wrapper-family", 0.1), (2, "vm-audit", 0.8), (2, "wrapper-family", 0.7), (3, "vm-audit", 0.6), (3, "wrapper-family", 0.0), (3, "generic-static", 1.0)]
    got = {r.artifact_id: (r.plugin_id, r.ambiguous) for r in C.select_route(spark.createDataFrame(rows, "artifact_id long, plugin_id string, confidence double")).collect()}
    assert got == {1: ("vm-audit", 0), 2: ("generic-static", 1), 3: ("generic-static", 0)}


def test_capabilities_ignore_comments_and_strings(spark):
    text = "local a = load('x')\n-- request\nlocal u = 'request https://x.example/a),'\ngame:HttpGet(u)\nload()"
    rows = C.classify(artifacts(spark, [(1, "a.lua", text, False)]))
    got = {r.api: (r.occurrences, r.lines) for r in inventory.capabilities(rows).collect()}
    assert got == {"load": (2, "1,5"), "HttpGet": (1, "4")}
    raw = {r.api for r in inventory.capabilities(rows, "text").collect()}
    assert raw == {"load", "HttpGet", "request"}
    assert [(r.line, r.url) for r in inventory.urls(rows).collect()] == [(3, "https://x.example/a")]


def test_byte_statistics(spark):
    rows = artifacts(spark, [(1, "a", "aab\x00", False), (2, "b", "", False)])
    counted = bytestats.histogram(rows)
    assert {(r.byte, r.n) for r in counted.collect()} == {(97, 2), (98, 1), (0, 1)}
    e = bytestats.entropy(counted, "artifact_id").first()
    assert (e.bits, e.distinct_bytes, e.zeros, e.printable_share) == (1.5, 3, 1, 0.75)
    assert {(r.parity, r.byte) for r in bytestats.parity_modes(rows).collect()} == {(0, 97), (1, 0)}
    run = bytestats.printable_runs(artifacts(spark, [(1, "a", "xx\x01loadstring\x02ab", False)])).first()
    assert (run.runs, run.longest, run.indicators) == (1, 10, "loadstring")


def instructions(spark, rows):
    return spark.createDataFrame(rows, "prototype long, pc long, raw_opcode int, word_a long, word_n long, word_q long")


def test_operand_modes(spark):
    rows = instructions(spark, [(1, 5, 187, 2 + 8 * 9, 3 + 8 * 2, 6 + 8 * 2)])
    got = {r.channel: (r.constant_index, r.child_index, r.resolved) for r in records.resolve(records.operands(rows)).collect()}
    assert got == {"a": (9, None, None), "n": (None, None, 7), "q": (None, None, 3)}


def test_control_flow_of_a_loop(spark):
    # 1: jump to 3; 2: unreached; 3: test, branch to 5; 4: jump to 3; 5: return. Word q names a register, as an effect needs one.
    register = 7 + 8 * 9
    words = [(1, 1, 136, 0, 8 * 2, register), (1, 2, 187, 0, 0, register), (1, 3, 21, 0, 8 * 4, register), (1, 4, 136, 0, 8 * 2, register), (1, 5, 118, 0, 0, register)]
    # The same words without a register, and with a register that is too small for the test's: nothing is plausible, so all falls through.
    rows = instructions(spark, words + [(2, *w[1:5], 0) for w in words] + [(3, 1, 21, 8 * 30, 8 * 2, 7), (3, 2, 187, 0, 0, 0), (3, 3, 187, 0, 0, 0)])
    flow = graph.flow(rows)
    blocks = graph.blocks(flow)
    edges = graph.edges(flow, blocks)
    got = {(r.prototype, r.block_start, r.block_end) for r in blocks.collect()}
    assert got == {(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5), (2, 1, 5), (3, 1, 3)}
    assert {(r.src, r.dst) for r in edges.where("prototype = 1").collect()} == {(1, 3), (2, 3), (3, 4), (3, 5), (4, 3)}
    assert edges.where("prototype > 1").count() == 0
    assert {(r.prototype, r.block_start) for r in flowtree.reachable(edges, blocks).collect()} == {(1, 1), (1, 3), (1, 4), (1, 5), (2, 1), (3, 1)}


def test_dominators_and_loops(spark):
    # 1 -> 2 -> 3 -> 2, 3 -> 4 -> 4, 4 -> 5; 6 -> 2 is never reached; a diamond in prototype 2
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 3, 4), (1, 4, 4), (1, 4, 5), (1, 6, 2), (2, 1, 2), (2, 1, 3), (2, 2, 4), (2, 3, 4)], "prototype long, src long, dst long")
    blocks = spark.createDataFrame([(1, k) for k in range(1, 7)] + [(2, k) for k in range(1, 5)], "prototype long, block_start long")
    pairs = graph.dominators(edges, blocks)
    got = {}
    for r in pairs.collect():
        got.setdefault((r.prototype, r.block_start), set()).add(r.dominator)
    assert got == {(1, 1): {1}, (1, 2): {1, 2}, (1, 3): {1, 2, 3}, (1, 4): {1, 2, 3, 4}, (1, 5): {1, 2, 3, 4, 5}, (2, 1): {1}, (2, 2): {1, 2}, (2, 3): {1, 3}, (2, 4): {1, 4}}
    loops = {(r.prototype, r.header, r.latch): (r.body, r.exits, r.rank) for r in graph.natural_loops(edges, pairs).collect()}
    assert loops == {(1, 4, 4): (1, 1, 1), (1, 2, 3): (2, 1, 2)}
    assert graph.natural_loops(edges.limit(0), graph.dominators(edges.limit(0), blocks.limit(0))).count() == 0


def test_encoded_streams_and_their_readings(spark):
    import base64
    import struct

    text = "a = [==[LPH!x]=]y]==] b = \"LPHq\" c = 'LPHr' d = [[no]] e = [[LPH\n]]"
    rows = streams.encoded_streams(artifacts(spark, [(1, "a", text, False), (2, "b", None, False)]))
    assert [(r.ordinal, r.body) for r in rows.orderBy("ordinal").collect()] == [(1, "LPH!x]=]y"), (2, "LPHq"), (3, "LPHr"), (4, "LPH\n")]

    data = struct.pack(">3I", 7, 0, 0xFFFFFFFF)
    body = base64.a85encode(data).decode()
    assert "z" in body
    for t, big in ((body, data), ("", b""), ("!!!!", None), ("uuuuu", None), ("!!z!!!", None), ("!!!!é", None)):
        got = spark.createDataFrame([(t,)], "t string").select(streams.ascii85(F.col("t"), False), streams.ascii85(F.col("t"), True)).first()
        assert got[0] == big
        assert got[1] == (None if big is None else b"".join(big[k : k + 4][::-1] for k in range(0, len(big), 4)))
    found = spark.createDataFrame([(1, "LPH@" + body, 7), (2, "LPH", 1), (3, None, None)], "id int, body string, declared int")
    tried = streams.candidates(found, "body", "declared")
    assert {(r["rank"], r.skip, r.little) for r in tried.collect()} == {(3, 4, True), (4, 4, False), (7, 9, True), (8, 9, False)}
    best = streams.accepted(tried, "id").collect()
    assert [(r.id, r.skip, r.little) for r in best] == [(1, 4, True)]


def test_coverage_adds_up(spark):
    rows = instructions(spark, [(1, 1, 187, 0, 0, 0), (1, 2, 39, 0, 0, 0), (2, 1, 999, 0, 0, 0)])
    got = {r.section: (r.total, r.proven, r.protocol, r.unresolved, r.partition_ok) for r in records.coverage(rows, F.col("prototype")).collect()}
    assert got == {1: (2, 1, 1, 0, 1), 2: (1, 0, 0, 1, 1), None: (3, 1, 1, 1, 1)}
    assert len(fixed.OPCODES) == 72
    assert len(fixed.PROTOCOL_OPCODES) == 16


def test_listing_labels(spark):
    text = "head ::L1::\r\nlocal function f(a)\n::L1:: x\n::L1:: goto L2\nlocal function g()\n::L2:: goto L2"
    lines = audit.audit_lines(artifacts(spark, [(1, "a", text, False)]))
    got = {r.function: (r.definitions, r.duplicates, r.uses, r.unresolved) for r in audit.label_scope(lines).collect()}
    assert got == {"f": (2, 1, 1, 1), "g": (1, 0, 1, 0)}


def test_diagnostics_and_outputs(spark):
    d = "artifact_id long, code string, message string"
    merged = audit.merge_diagnostics(spark.createDataFrame([(1, "a", "m")], d), spark.createDataFrame([(1, "a", "m"), (1, "b", "m")], d))
    assert sorted((r.code for r in merged.collect())) == ["a", "b"]
    need = spark.createDataFrame([(1, "x"), (1, "y")], "artifact_id long, role string")
    have = spark.createDataFrame([(1, "x", 0), (1, "y", 3)], "artifact_id long, role string, n_bytes long")
    assert [r.role for r in audit.missing_outputs(need, have).collect()] == ["x"]


def test_numbers_round_trip(spark):
    values = [0, 1, 127, 128, 624485, (1 << 53) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", chunk.uleb_bytes(F.col("v")).alias("b"))
    for r in rows.select("v", "b", chunk.uleb_value(F.col("b")).alias("back")).collect():
        assert r.back == r.v
        assert len(r.b) == max(1, -(-r.v.bit_length() // 7))
    assert rows.where("v = 624485").first().b == [229, 142, 38]


def test_files_bundle_and_verification(spark, tmp_path):
    from bytequarry.plans import routes

    (tmp_path / "in").mkdir()
    for name, data in {"a.lua": b"local x = load(1)\nreturn x", "b.luac": b"\x1bLuaQ\x00", "c.txt": b"\xff\xfe", "d.py": b"no", "e.TXT": b"\xef\xbb\xbfbom", "big.lua": b"x" * 200}.items():
        (tmp_path / "in" / name).write_bytes(data)
    rows = files.read_files(spark, str(tmp_path / "in"), 100)
    got = {r.file_name: r for r in C.classify(rows).collect()}
    assert sorted(got) == ["a.lua", "b.luac", "c.txt", "e.TXT"]
    assert (got["a.lua"].kind, got["b.luac"].kind, got["c.txt"].kind) == ("lua-source", "lua-bytecode", "binary")
    assert got["e.TXT"].text == "bom"
    outputs = routes.analyze(rows)
    manifest = files.write_bundle(outputs, str(tmp_path / "out"))
    assert manifest.count() == outputs.count() > 8
    again = files.artifact_records(outputs)
    assert files.changed_files(manifest, again).count() == 0
    changed = again.withColumn("sha256", F.when(F.col("role") == "report", "x").otherwise(F.col("sha256")))
    assert {r.state for r in files.changed_files(manifest, changed).collect()} == {"different"}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_bundle(outputs, str(tmp_path / "out"))


def test_arriving_files_are_classified_once(spark, tmp_path):
    from bytequarry.streaming import watch

    (tmp_path / "in").mkdir()
    where = [str(tmp_path / x) for x in ("in", "out", "marks")]
    for name in ("a.lua", "b.lua"):
        (tmp_path / "in" / name).write_text("local x return x")
        watch.start(spark, *where, once=True).awaitTermination()
    got = spark.read.parquet(where[1]).collect()
    assert sorted(r.file_name for r in got) == ["a.lua", "b.lua"]
    assert {r.kind for r in got} == {"lua-source"}


def test_empty_tables(spark):
    rows = artifacts(spark, [])
    classified = C.classify(rows)
    assert C.select_route(C.detect(C.counts(classified))).count() == 0
    assert inventory.capabilities(classified).count() == inventory.urls(classified).count() == 0
    flow = graph.flow(instructions(spark, []))
    assert flowtree.reachable(graph.edges(flow, graph.blocks(flow)), graph.blocks(flow)).count() == 0


def test_linear_patterns_have_the_same_matches():
    import random
    import re
    import time

    rng = random.Random(5)
    for _ in range(20_000):
        source = "".join(rng.choice("=== \n\t;;((()).[-+,ab_1") for _ in range(rng.randint(1, 24)))
        for plain, linear in fixed.LINEAR.items():
            assert [m.span() for m in re.finditer(plain, source)] == [m.span() for m in re.finditer(linear, source)], (plain, source)
    start = time.monotonic()
    assert [len(re.findall(p, "t = " + " " * 20_000 + "\n")) for p in fixed.LINEAR.values()] == [0] * len(fixed.LINEAR)
    assert time.monotonic() - start < 2


def test_capability_lines_are_found_by_literal_patterns(spark):
    text = "x load y\nloader\n\nload\rload . load\nsyn\n.request syn.request"
    rows = inventory.capabilities(spark.createDataFrame([(1, text)], "artifact_id long, code string"))
    assert {(r.api, r.occurrences, r.lines) for r in rows.collect()} == {("load", 4, "1,4"), ("request", 2, "6")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "s.pattern" not in plan and "pattern AS" not in plan  # a pattern that is a column is compiled for every line
    assert text_functions.java(r"\bload\b").startswith("load")


def test_masked_by_first_signs_without_a_pattern_a_token(spark):
    cases = {"a - b[1] --c\rd\ne": "a - b[1]    \r \ne", "x = '\U0001f600é' [": "x =      [", '"': " ", "[[a\r\n\nb]] - [": "   \r\n\n    - [", "--": "  ", "a\n--[==[ -\n]==]\n-": "a\n        \n    \n-", "": ""}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").withColumn("got", text_functions.masked(F.col("text")))
    assert all(r.got == r.want for r in rows.collect())
    assert "^(?:" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_loader_facts_look_for_names_only_before_what_follows_them(spark):
    code = "f = function (a) g=function() f =\n function() x = math . floor y=string.rep len [12] [ 7 ] [12 ] readu8x readu8 ... })  : go ( ) ;"
    rows = inventory.loader_facts(spark.createDataFrame([(1, code), (2, "")], "artifact_id long, code string"))
    a, b = sorted(rows.collect())
    assert tuple(a) == (1, 3, "f,g", "go", "x -> math.floor,y -> string.rep", 1, "len,readu8") and tuple(b) == (2, 0, "", None, "", 0, "")
    assert "=\\s*+function" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_classes_need_no_copy_in_lower_case(spark):
    rows = [(1, "1.txt", "if x"), (2, "2.txt", "if x then"), (3, "3.txt", "MOONSEC v3 0XFF"), (4, "4.txt", "elseif xend\nif")]
    table = spark.createDataFrame(rows, "artifact_id long, file_name string, text string").withColumn("is_bytecode", F.lit(False))
    counted = C.counts(C.classify(table))
    got = {r.artifact_id: (r.kind, r.wrapper_raw, r.hex) for r in counted.collect()}
    assert got == {1: ("text", 0, 0), 2: ("lua-source", 0, 0), 3: ("text", 1, 1), 4: ("text", 0, 0)}
    assert "lower(text" not in counted._jdf.queryExecution().analyzed().toString()
