"""Dataflow, trees, loops, emission order and interval joins against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import fixed
from bytequarry.operators import dataflow, flowtree, graph, lexical
from bytequarry.plans.tables import written_rows
from bytequarry.plans.catalogue import QUERIES


def random_graphs(seed, graphs=25, most=14):
    rng = random.Random(seed)
    out = {}
    for p in range(graphs):
        n = rng.randint(1, most)
        out[p] = (n, {(u, v) for u in range(1, n + 1) for v in [u + 1, *(rng.randint(1, n) for _ in range(rng.choice([0, 0, 1, 2])))] if v <= n and rng.random() < 0.9})
    return out


def tables(spark, graphs):
    edges = spark.createDataFrame([(p, u, v) for p, (_, e) in graphs.items() for u, v in e], "prototype long, src long, dst long")
    blocks = spark.createDataFrame([(p, b, b) for p, (n, _) in graphs.items() for b in range(1, n + 1)], "prototype long, block_start long, block_end long")
    return edges, blocks


def reach(edges, without=None, start=1):
    seen, stack = set(), [start] if without != start else []
    while stack:
        u = stack.pop()
        if u not in seen:
            seen.add(u)
            stack += [v for a, v in edges if a == u and v != without]
    return seen


def plain_dominators(edges):
    live = reach(edges)
    return {b: {d for d in live if d == b or b not in reach(edges, d)} for b in live}


@pytest.fixture(scope="module")
def flow(spark):
    graphs = random_graphs(4)
    edges, blocks = tables(spark, graphs)
    return graphs, edges, blocks, flowtree.dominator_tree(edges, blocks).cache()


def test_spanning_tree_holds_what_is_reached(flow):
    graphs, edges, blocks, _ = flow
    rows = flowtree.spanning_tree(edges, blocks).collect()
    assert sorted((r.prototype, r.node) for r in rows) == sorted((p, b) for p, (_, e) in graphs.items() for b in reach(e))
    assert all((r.parent, r.node) in graphs[r.prototype][1] for r in rows if r.parent is not None)


def test_dominator_tree(flow):
    graphs, _, _, tree = flow
    rows = {(r.prototype, r.node): r for r in tree.collect()}
    for p, (_, e) in graphs.items():
        doms = plain_dominators(e)
        assert {b for q, b in rows if q == p} == set(doms)
        for b, d in doms.items():
            r = rows[p, b]
            assert r.parent == max(d - {b}, key=lambda x: len(doms[x]), default=None)
            assert {x for x in doms if rows[p, x].enter <= r.enter <= rows[p, x].leave} == d


def test_loop_nesting(flow):
    graphs, edges, _, tree = flow
    got = {(r.prototype, r.block_start): (r.depth, r.loop, r.outer) for r in flowtree.loop_nesting(edges, tree).collect()}
    want = {}
    for p, (_, e) in graphs.items():
        doms, bodies = plain_dominators(e), {}
        for u, v in e:
            if u in doms and v in doms[u]:
                body, stack = bodies.setdefault(v, {v}), [u]
                while stack:
                    x = stack.pop()
                    if x not in body:
                        body.add(x)
                        stack += [a for a, b in e if b == x and a in doms]
        least = lambda b, but=None: min(((len(s), h) for h, s in bodies.items() if b in s and h != but), default=(None, None))[1]
        for b in doms:
            if any(b in s for s in bodies.values()):
                want[p, b] = (sum(b in s for s in bodies.values()), least(b), least(least(b), least(b)))
    assert got == want


def test_a_path_of_many_blocks_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    edges = spark.range(1, n).select(F.lit(1).cast("long").alias("prototype"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    blocks = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("prototype"), F.col("id").alias("block_start"), F.col("id").alias("block_end"))
    rounds, real = [], flowtree.written
    monkeypatch.setattr(flowtree, "written", lambda df, name: rounds.append(name) or real(df, name))
    tree = flowtree.dominator_tree(edges, blocks)
    assert tree.where(f"enter = node and leave = {n} and post = {n} - node + 1").count() == n
    assert max(rounds.count(k) for k in set(rounds)) < 20


def plain_block_order(ways):
    order, queue = [], [1]
    while queue:
        at = queue.pop(0)
        while at in ways and at not in order:
            order.append(at)
            at, other = ways[at]
            queue.append(other)
    return {b: k + 1 for k, b in enumerate(order)}


def test_block_order(spark):
    rng = random.Random(21)
    pick = lambda n, share: rng.randint(1, n + 1) if rng.random() < share else None
    graphs = {p: {b: (b + 1 if rng.random() < 0.5 else pick(n, 0.8), pick(n, 0.7)) for b in range(1, n + 1)} for p in range(60) for n in [rng.randint(1, 12)]}
    graphs[60] = {2: (2, None)}  # no entry
    rows = spark.createDataFrame([(p, b, x, y) for p, g in graphs.items() for b, (x, y) in g.items()], "prototype long, block_start long, preferred long, alternative long")
    got = {(r.prototype, r.block_start): r.place for r in flowtree.block_order(rows).collect()}
    assert got == {(p, b): k for p, g in graphs.items() if 1 in g for b, k in plain_block_order(g).items()}
    assert flowtree.block_order(rows.limit(0)).count() == 0


def test_block_order_of_long_runs_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    rows = spark.range(1, n + 1).selectExpr("1L as prototype", "id as block_start", "id % 10000 + 1 as preferred", f"if(id = 5, {n}L, null) as alternative")
    rounds, real = [], flowtree.written
    monkeypatch.setattr(flowtree, "written", lambda df, name: rounds.append(name) or real(df, name))
    assert flowtree.block_order(rows).where("place = block_start").count() == n
    assert max(rounds.count(k) for k in set(rounds)) < 20


def plain_post_order(nodes, closures):
    parent = {}
    for c in nodes:
        makers = [m for m, x in closures if x == c and m != c and m in nodes]
        if makers:
            parent[c] = min(makers)
    for c in sorted(nodes):  # the smallest of a circle becomes a root
        seen, x = [], c
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            parent.pop(min(seen[seen.index(x) :]))
    out = []

    def visit(x):
        for c in sorted(c for c in nodes if parent.get(c) == x):
            visit(c)
        out.append(x)

    for x in sorted(nodes - set(parent)):
        visit(x)
    return {x: (parent.get(x), k + 1) for k, x in enumerate(out)}


def test_emission_order(spark):
    rng = random.Random(8)
    groups = {g: (set(range(1, n + 1)), [(rng.randint(1, n + 1), rng.randint(1, n + 1)) for _ in range(rng.randint(0, n + 2))]) for g, n in enumerate([1, 2, 3, 5, 8, 13, 20, 30])}
    closures = spark.createDataFrame([(g, m, c) for g, (_, e) in groups.items() for m, c in e], "prototype long, node long, child long")
    prototypes = spark.createDataFrame([(g, x) for g, (n, _) in groups.items() for x in n], "prototype long, node long")
    got = {(r.prototype, r.node): (r.parent, r.place) for r in flowtree.emission_order(closures, prototypes).collect()}
    assert got == {(g, x): v for g, (n, e) in groups.items() for x, v in plain_post_order(n, e).items()}
    assert flowtree.emission_order(closures.limit(0), prototypes.limit(0)).count() == 0


# --- registers -------------------------------------------------------------


def plain_registers(opcode, a, n, q):
    def spans(text):
        out = set()
        for part in filter(None, text.split(",")):
            ends = [eval(e, {"a": a, "n": n, "q": q}) for e in part.split("..")]  # noqa: S307
            out |= set(range(ends[0], ends[-1] + 1))
        return out

    reads, writes = (spans(x) for x in fixed.REGISTER_EFFECTS[opcode])
    if opcode == 62:  # an open number of arguments or results
        reads |= {a + 1} if n == 0 else set()
        writes |= {a} if q == 0 else set()
    return reads, writes


def test_every_effect_fits_the_largest_register_that_plausibility_looks_at(spark):
    rows = [(o, a, n, q) for o in fixed.LARGEST_REGISTER for a, n, q in [(3, 5, 7), (7, 5, 3), (5, 7, 3), (2, 9, 4), (9, 2, 2)]]
    table = spark.createDataFrame(rows, "raw_opcode long, a long, n long, q long")
    case = "case raw_opcode " + " ".join(f"when {o} then {e}" for o, e in fixed.LARGEST_REGISTER.items()) + " end"
    assert set(fixed.REGISTER_EFFECTS) == set(fixed.LARGEST_REGISTER) == {o[0] for o in fixed.OPCODES}
    for r in table.withColumn("largest", F.expr(case)).collect():
        reads, writes = plain_registers(r.raw_opcode, r.a, r.n, r.q)
        if r.raw_opcode not in (73, 176):  # loops: their registers are named by place, and never judged
            named = max(reads | writes, default=-1)
            # a span without registers (a call without arguments) still names its first one
            assert named <= r.largest if ".." in "".join(fixed.REGISTER_EFFECTS[r.raw_opcode]) or r.raw_opcode in (131, 259) else named == r.largest, r


def instructions(seed, prototypes=12, most=9):
    rng, out = random.Random(seed), []
    pool = [71, 25, 187, 125, 58, 136, 36, 219, 9, 97, 71, 25, 300, 62, 62]
    for p in range(prototypes):
        for pc in range(1, rng.randint(1, most) + 1):
            out.append((p, pc, rng.choice(pool), rng.randint(0, 4) * 8 + rng.choice([7, 7, 2]), rng.randint(0, 4) * 8 + 7, rng.randint(0, 4) * 8 + 7))
    return out


def test_registers_def_use_and_single_use(spark):
    from bytequarry.operators import graph

    rows = instructions(3)
    table = spark.createDataFrame(rows, "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    effects = dataflow.register_effects(table)
    want = set()
    for p, pc, o, wa, wn, wq in rows:
        if o in fixed.REGISTER_EFFECTS:
            reads, writes = plain_registers(o, wa // 8, wn // 8, wq // 8)
            ceiling = max(w // 8 if w % 8 == 7 else -1 for w in (wa, wn, wq))
            if ceiling >= 0 and max(reads | writes, default=-1) <= ceiling + fixed.REGISTER_SLACK:
                want |= {(p, pc, "read", r) for r in reads} | {(p, pc, "write", r) for r in writes}
    got = [(r.prototype, r.pc, r.access, r.register) for r in effects.collect()]
    assert len(got) == len(set(got)) and set(got) == want

    flow = graph.flow(table)
    blocks = graph.blocks(flow).cache()
    edges = graph.edges(flow, blocks).cache()
    span = [(r.prototype, r.block_start, r.block_end) for r in blocks.collect()]
    nexts = {}
    for r in edges.collect():
        nexts.setdefault((r.prototype, r.src), []).append(r.dst)
    touch = lambda p, pc, access: {r for q, k, a, r in want if (q, k, a) == (p, pc, access)}
    chains, live = set(), {(p, b): set() for p, b, _ in span}
    for p, b, e in span:
        last = {}
        for pc in range(b, e + 1):
            chains |= {(p, b, r, pc, last.get(r)) for r in touch(p, pc, "read")}
            last |= dict.fromkeys(touch(p, pc, "write"), pc)
    for _ in span:  # backwards, as often as there are blocks
        for p, b, e in span:
            now = set().union(*(live[p, d] for d in nexts.get((p, b), [])))
            for pc in range(e, b - 1, -1):
                now = (now - touch(p, pc, "write")) | touch(p, pc, "read")
            live[p, b] = now
    placed = dataflow.in_blocks(effects, blocks).cache()
    assert {(r.prototype, r.block_start, r.register, r.pc, r.def_pc) for r in dataflow.def_use(placed).collect()} == chains
    assert {(r.prototype, r.block_start, r.register) for r in dataflow.liveness(placed, edges).collect()} == {(p, b, r) for (p, b), rs in live.items() for r in rs}
    once = set()
    for p, b, r, _, d in chains:
        uses = [c for c in chains if c[:3] == (p, b, r) and c[4] == d]
        end = next(e for q, s, e in span if (q, s) == (p, b))
        after = any(r in touch(p, k, "write") for k in range(d + 1, end + 1)) if d else False
        if d and len(uses) == 1 and (after or all(r not in live[p, x] for x in nexts.get((p, b), []))):
            once.add((p, b, r, d, uses[0][3]))
    assert {(r.prototype, r.block_start, r.register, r.def_pc, r.use_pc) for r in dataflow.single_use(placed, edges).collect()} == once


def test_wide_spans_are_dealt_out(spark):
    """a row made all registers of its instruction at once, so that one wide span lay in one task."""
    from pyspark.sql import functions as F

    width = 100_000
    rows = [(1, 1, 154, width * 8 + 7, 7, 2 * 8 + 7), (1, 2, 71, 5 * 8 + 7, 4 * 8 + 7, 7)]
    table = spark.createDataFrame(rows, "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    effects = dataflow.register_effects(table).withColumn("task", F.spark_partition_id())
    got = effects.groupBy("pc", "access").agg(F.count("*").alias("n"), F.count_distinct("register").alias("d"), F.min("register").alias("lo"), F.max("register").alias("hi"), F.count_distinct("task").alias("tasks")).collect()
    assert {(r.pc, r.access): (r.n, r.d, r.lo, r.hi) for r in got} == {(1, "write"): (width, width, 2, width + 1), (2, "write"): (1, 1, 4, 4)}
    assert next(r.tasks for r in got if r.pc == 1) > 1


def test_wide_spans_take_little_disk(spark, tmp_path):
    """pieces that began at any register, in any order, took about four bytes a row of a file."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    ends = [(rng.randint(0, 3000), rng.randint(20_000, 30_000)) for _ in range(80)]
    table = spark.createDataFrame([(p, 1, 192, a * 8 + 7, 7, q * 8 + 7) for p, (a, q) in enumerate(ends)], "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    dataflow.register_effects(table).write.parquet(out := str(tmp_path / "effects"))
    got = spark.read.parquet(out).groupBy("prototype").agg(F.count("*").alias("n"), F.count_distinct("register").alias("d"), F.min("register").alias("lo"), F.max("register").alias("hi")).collect()
    assert sorted((r.prototype, r.n, r.d, r.lo, r.hi) for r in got) == [(p, q - a + 1, q - a + 1, a, q) for p, (a, q) in enumerate(ends)]
    assert sum(f.stat().st_size for f in (tmp_path / "effects").glob("*.parquet")) < sum(q - a + 1 for a, q in ends)


def test_spans_of_one_access_that_overlap(spark, monkeypatch):
    monkeypatch.setitem(fixed.REGISTER_EFFECTS, 250, ("a - 3..a + 4, n, a..q, n..n", "a..q, n..q + 1"))
    rng = random.Random(20)
    rows = [(1, pc, 250, *(rng.randint(0, 9) * 8 + 7 for _ in range(3))) for pc in range(1, 200)]
    table = spark.createDataFrame(rows, "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    want = []
    for _, pc, _, a, n, q in rows:
        a, n, q = a // 8, n // 8, q // 8
        want += [(pc, "read", r) for r in {*range(a - 3, a + 5), n, *range(a, q + 1)} if r >= 0] + [(pc, "write", r) for r in {*range(a, q + 1), *range(n, q + 2)}]
    assert sorted((r.pc, r.access, r.register) for r in dataflow.register_effects(table).collect()) == sorted(want)


def test_known_values(flow, spark):
    graphs, edges, _, tree = flow
    rng = random.Random(6)
    ends = {(p, b, r): rng.choice(["x", "x", "y", None]) for p, (n, _) in graphs.items() for b in range(1, n + 1) for r in range(3) if rng.random() < 0.4}
    assigned = spark.createDataFrame([(*k, v) for k, v in ends.items()], "prototype long, block_start long, register long, value string")
    reached = tree.select("prototype", F.col("node").alias("block_start"))
    got = {(r.prototype, r.block_start, r.register): r.value for r in dataflow.known_values(assigned, edges, reached).collect()}
    want = {}
    for p, (_, e) in graphs.items():
        live = reach(e)
        top = object()
        store = {b: {r: None if b == 1 else top for r in range(3)} for b in live}
        for _ in range(4 * len(live) + 4):
            for b in live - {1}:
                for r in range(3):
                    values = {ends.get((p, a, r), store[a][r]) for a in live if (a, b) in e} - {top}
                    store[b][r] = top if not values else values.pop() if len(values) == 1 else None
        want |= {(p, b, r): v for b in live for r, v in store[b].items() if v is not None and v is not top}
    assert got == want


# --- regions and lines -----------------------------------------------------------


def test_lines_of_offsets(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SUM_ROWS", 5)
    rng = random.Random(2)
    texts = ["", "\n", "a", "\n\n\n", None, *("".join(rng.choice("ab\né") for _ in range(rng.randint(1, 200))) for _ in range(12))]
    sources = spark.createDataFrame(list(enumerate(texts)), "artifact_id long, text string")
    starts = lexical.line_starts(sources)
    plain = {k: [0, *(i + 1 for i, c in enumerate(t or "") if c == "\n")] for k, t in enumerate(texts)}
    assert sorted((r.artifact_id, r.line, r.start) for r in starts.collect()) == sorted((k, i + 1, s) for k, v in plain.items() for i, s in enumerate(v))
    asked = [(k, o, "x") for k in plain for o in (-1, 0, 1, 7, 50, 199, 100_000)] + [(999, 3, "x"), (1, None, "x"), (1, 1, "x")]
    offsets = spark.createDataFrame(asked, "artifact_id long, offset long, note string")
    for span in (4, 64, 1 << 14):
        got = sorted(((r.artifact_id, r.offset, r.line) for r in lexical.lines_of(offsets, starts, span=span).collect()), key=str)
        assert got == sorted(((k, o, None if o is None or o < 0 or k not in plain else sum(s <= o for s in plain[k])) for k, o, _ in asked), key=str)


def test_regions_of_a_long_text(spark):
    text = "x = 'a\\'b' -- c\n" * 40_000 + "--[==[ ]] ]==] [[ open\n"
    sources = spark.createDataFrame([(1, text), (2, ""), (3, None)], "artifact_id long, text string")
    rows = lexical.regions_with_lines(sources)
    assert rows.count() == 80_002
    last = rows.orderBy(F.col("start").desc()).limit(2).collect()
    assert [(text[r.start : r.end], r.first_line, r.last_line) for r in last] == [("[[ open\n", 40_001, 40_001), ("--[==[ ]] ]==]", 40_001, 40_001)]


def test_values_that_blocks_leave(spark):
    rows = [(1, 1, 71, 9 * 8 + 2, 8, 0), (1, 2, 25, 0, 0, 2 * 8), (1, 3, 187, 8, 3 * 8, 0), (1, 4, 135, 5 * 8 + 3, 4 * 8, 6 * 8 + 6), (1, 5, 137, 4 * 8 + 2, 7 * 8 + 4, 5 * 8), (1, 6, 72, 2, 1 * 8, 8 + 1)]
    table = spark.createDataFrame(rows, "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    placed = spark.createDataFrame([(1, 1, r, "write", pc) for pc, r in [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)]], "prototype long, block_start long, register long, access string, pc long")
    assert {r.register: r.value for r in dataflow.assigned_values(placed, table).collect()} == {1: "1*k0", 2: "nil", 3: None, 4: "9+-2", 5: "p7-k4"}


# --- budgets, declarations, guards ------------------------------------------------


def test_budget_skips_and_goes_on(spark):
    from bytequarry.operators import inventory

    rng = random.Random(9)
    rows = [(k, i, rng.choice([0, 1, 3, 10, 40, 101, None])) for k in [1, 2, 3, None] for i in range(60)] + [(7, i, 1) for i in range(3000)] + [(8, 0, 101)]
    table = spark.createDataFrame([(k, i, n, "x") for k, i, n in rows], "key long, line long, size long, note string")
    got = {(r.key, r.line) for r in inventory.budget_selection(table, "key", "line", "size", 100).collect()}
    want, left = set(), {}
    for k, i, n in rows:
        if n is not None and n <= left.setdefault(k, 100):
            left[k] -= n
            want.add((k, i))
    assert got == want
    assert inventory.budget_selection(table.limit(0), "key", "line", "size", 100).count() == 0


def test_declarations(spark):
    from bytequarry.operators import validate

    protos = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0), (2, 250, 251, 61, 8, -1, 5), (3, 251, 3, 60, 7, 0, -1), (4, 1, 1, 0, 0, 0, 0), (5, None, None, None, None, None, None)], "prototype long, max_stack long, parameters long, upvalues long, vararg_flags long, first_line long, last_line long")
    lines = spark.createDataFrame([(1, 0, -1), (1, 1, 0), (1, 2, None)], "prototype long, index long, line long")
    strings = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, None)], "prototype long, index long, n_bytes long")
    rows = sorted(((r.prototype, r["index"], r.code.removeprefix("LUA51_"), r.severity) for r in validate.declarations(protos, lines, strings).collect()), key=str)
    assert rows == sorted([
        (1, None, "INVALID_MAX_STACK", "error"), (2, None, "PARAMETERS_EXCEED_STACK", "error"), (2, None, "INVALID_VARARG_FLAGS", "error"), (2, None, "NONCANONICAL_UPVALUE_COUNT", "warning"), (2, None, "NEGATIVE_SOURCE_LINE", "warning"),
        (3, None, "INVALID_MAX_STACK", "error"), (3, None, "NEGATIVE_SOURCE_LINE", "warning"), (1, 0, "NEGATIVE_DEBUG_LINE", "warning"), (1, 0, "NULL_STRING_CONSTANT", "error"),
    ], key=str)


def test_signs_that_patterns_hold_lose_no_match(spark, sf_dir):
    from bytequarry.functions.text import count, java
    from bytequarry.plans import views

    known = {p for _, p, _ in fixed.AUDIT_SIGNALS} | {p for _, p in fixed.LUAU_SIGNALS} | {p for _, _, p in fixed.COUNTS}
    assert known <= set(fixed.HELD)
    extra = ["0XfF %0x1 %  0XA", "MOONSEC v3 x", "-- STACK SLOTS: 1; decoded instructions: 2; reachable cfg INSTRUCTIONS: 3", "export type A = b", "type B =", "a //= 2 b ..= 'c'", "`x`", "Protected USING luraph obfuscator V14.7", "-- Source Path: root.M[3]", "K K LURAPH"]
    texts = views.programs(spark, sf_dir).select("text").union(spark.createDataFrame([(t,) for t in extra], "text string"))
    both = [(F.sum(count(F.col("text"), p)), F.sum(F.regexp_count("text", F.lit(java(p))))) for p in fixed.HELD]
    row = texts.select(*(c.alias(f"c{k}_{i}") for k, pair in enumerate(both) for i, c in enumerate(pair))).first()
    for k, p in enumerate(fixed.HELD):
        assert row[f"c{k}_0"] == row[f"c{k}_1"], p


def test_rows_of_small_numbers_are_not_broadcast(spark, sf_dir, tmp_path):
    """Spark takes such tables for small by the size of their files, or of what they are exploded from."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(QUERIES["lua51_link_checks"](spark, sf_dir))
    rows = written_rows(spark.range(100).selectExpr("id as prototype", "1L as node"), "rows")
    assert "BroadcastExchange" not in plan(rows.join(spark.range(9).withColumnRenamed("id", "prototype"), "prototype"))
    assert "BroadcastExchange" not in plan(QUERIES["def_use"](spark, sf_dir))


def test_effects_on_read_registers_need_no_row_for_each_that_is_written(spark):
    """A write of very many registers (opcode 154 writes q..q + a - 1) is met only where the prototype reads one of them."""
    row = lambda pc, opcode, a, n, q: (1, pc, opcode, 8 * a + 7, 8 * n + 7, 8 * q + 7)
    rows = [row(1, 154, 3_000_000, 0, 5), row(2, 9, 0, 1_000_000, 0), row(3, 25, 0, 0, 40), row(4, 9, 0, 40, 0)]
    ins = spark.createDataFrame(rows, "prototype long, pc long, raw_opcode long, word_a long, word_n long, word_q long")
    got = {(r.pc, r.access, r.register) for r in dataflow.effects_on(ins).collect()}
    assert got == {(1, "write", 40), (1, "write", 1_000_000), (2, "read", 1_000_000), (3, "write", 40), (4, "read", 40)}
    wanted = dataflow.assigned_registers(ins)
    assert [r.register for r in wanted.collect()] == [40]
    assert {(r.pc, r.access) for r in dataflow.effects_on(ins, wanted).collect()} == {(1, "write"), (3, "write"), (4, "read")}


def test_numbers_of_shallow_and_deep_forests_agree(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(p, n, rng.choice([None, *range(1, n)]) if n > 1 else None) for p in range(8) for n in range(1, rng.randint(2, 30))]
    rows += [(9, n, n + 1 if n < 40 else None) for n in range(1, 41)]
    tree = spark.createDataFrame(rows, "prototype long, node long, parent long")
    assert flowtree._ways(tree) is None and flowtree._ways(tree.where("prototype < 9")) is not None
    monkeypatch.setattr(flowtree, "SHALLOW", 64)
    shallow = {tuple(r) for r in flowtree.numbered(tree).collect()}
    monkeypatch.setattr(flowtree, "SHALLOW", 0)
    columns = ["prototype", "node", "parent", "enter", "leave", "post"]
    assert shallow == {tuple(r) for r in flowtree.numbered(tree).select(*columns).collect()}


def test_references_and_headers_are_dealt_out_over_more_tasks_as_they_grow(spark, monkeypatch):
    from bytequarry.operators import records
    from bytequarry.plans import tables as shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    spread = spark.range(400).selectExpr("id % 7 as k")
    assert shared.dealt(spread, "k", 400).rdd.getNumPartitions() == 40
    assert shared.dealt(spread, "k", 20).rdd.getNumPartitions() == spread.rdd.getNumPartitions()
    resolved = spark.range(400).selectExpr("id as prototype", "id as pc", "'a' as channel", "id % 50 as constant_index", "cast(null as bigint) as child_index")
    known = spark.range(49).selectExpr("id as constant_index", "id % 2 = 0 as is_string")
    refs = records.references(resolved, known, spark.range(3).selectExpr("id as child_index"), 400)
    assert "RepartitionByExpression [constant_index" in refs._jdf.queryExecution().optimizedPlan().toString()
    assert refs.count() == 400 and refs.where("not found").count() == 8


def test_only_prototypes_with_a_circle_can_have_loops(spark):
    graphs = random_graphs(11)
    edges, _ = tables(spark, graphs)
    some = {r.prototype for r in graph.circling(edges).collect()}
    for p, (n, e) in graphs.items():
        assert p in some or all(u not in reach(e, start=v) for u, v in e)
    assert 0 < len(some) < len(graphs)


def test_emission_order_moves_no_pairs_of_a_group(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(flowtree, "emission_order", lambda made, orders: seen.append(made) or made)
    QUERIES["emission_order"](spark, sf_dir)
    assert seen[0].groupBy("prototype", "child").count().where("count > 1").count() == 0
