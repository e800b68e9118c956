import random
import re
import time

from bytequarry.llm import pii
from tests.llm.helpers import SCHEMA, awkward, docs


def plain(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_fixed_patterns_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.-1+ 9(b0_é") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            t += "".join(rng.choice("0123456789 -") for _ in range(20))
        assert plain(t) == pii.base_spans(t), t


def test_long_runs_take_linear_time():
    start = time.time()
    pii.base_spans("a" * 10**6 + "@" + "1" * 10**6 + "@." * 10**5 + "+" + " " * 10**6)
    assert time.time() - start < 20


def test_find_and_redact(spark):
    rows = awkward() + [(700, "write to ann.b@mail.example.com or +1 (802) 555-9869, card 4913187196670932 at 53.121.55.90 now", "a")]
    table = docs(spark, rows, clash=True)
    got = {r.doc_id: r for r in pii.find(table).collect()}
    r = got[700]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 1, 1, 0)
    assert r.spans == "email:9:31,phone:35:52,card:59:75,ip:79:91"
    assert pii.find(table).count() == len(rows)
    out = pii.redact(table)
    assert out.columns == table.columns
    masked = {r.doc_id: r for r in out.collect()}
    assert masked[700].text == "write to <email> or <phone>, card <card> at <ip> now"
    assert masked[700].n_chars == len(masked[700].text)
    assert masked[1].text is None
    assert masked[4].text == rows[3][1]


def test_patterns_discover_identifiers(spark):
    seeds = [(k, f"please call us at +1 (802) 555-98{k:02d} today", "a") for k in range(10, 40)]
    unseen = [(100, "please call us at 802.5559.871 today", "a"), (101, "the year at 1234567 was", "a")]
    noise = [(200 + k, f"order number was {10_000_000 + k} ok", "a") for k in range(20)]
    table = docs(spark, seeds + unseen + noise)
    got = {r.doc_id: r for r in pii.find(table).collect()}
    assert got[100].spans == "phone:18:30"
    assert got[100].n_phone == 0
    assert got[101].spans == ""
    assert all(got[200 + k].n_added == 0 for k in range(20))
    assert "<phone>" in next(r.text for r in pii.redact(table).collect() if r.doc_id == 100)


def test_patterns_discover_every_form(spark):
    rows = [(k, f"please call us at +1 (802) 555-98{k:02d} today", "a") for k in range(10, 40)]
    rows += [(50 + k, f"kindly write to ann{k}@mail.example.com today", "a") for k in range(40)]
    rows += [(120 + k, f"pay by card {card} today", "a") for k, card in enumerate(("4913187196670932", "4845168114407329", "4417744280351547", "4929348385146306", "4952935900253052"))]
    long = "x" * 80 + "-1234567"
    unseen = {
        200: ("please call us at 802 555 9871 today", "phone:18:30"),
        201: ("please call us at (802) 555-9872 today", "phone:19:32"),
        202: ("kindly write to ann@localhost, today", "email:16:29"),
        203: ("kindly write to ann at mail.example today", "email:16:35"),
        204: ("kindly write to ann dot b (at) mail [dot] example today", "email:16:49"),
        205: ("pay by card 4913 1871 9667 0933 today", "card:12:31"),
        206: (f"please call us at {long} today", f"phone:18:{18 + len(long)}"),
        207: ("please call us at 802 today", "phone:18:21"),
        208: ("look at him. ann@nowhere or 802 555 1111 or 802", ""),
    }
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, rows + [(i, t, "a") for i, (t, _) in unseen.items()])).collect()}
    assert {i: got[i] for i in unseen} == {i: s for i, (_, s) in unseen.items()}


def test_adopted_identifiers_are_marked_everywhere(spark):
    rows = [(k, f"please call us at +1 (802) 555-98{k:02d} today", "a") for k in range(10, 40)]
    number = lambda level, k: f"802.5559.{level}{k}1"
    texts = {}
    for level in range(6):  # a level's pattern is trusted once the level's numbers are adopted
        if level:
            rows += [(1000 * level + k, f"or ring desk {'abcdef'[level]}: +1 (802) 555-98{k:02d} today", "a") for k in range(10, 30)]
            texts |= {1000 * level + 100 + k: f"or ring desk {'abcdef'[level]}: {number(level, k)} today" for k in range(5)}
        if level < 5:
            before = f"or ring desk {'abcdef'[level]}:" if level else "please call us at"
            texts |= {1000 * level + 200 + k: f"{before} {number(level + 1, k)} today" for k in range(5)}
    texts |= {7000 + k: f"{w} saw {number(1, 0)} there" for k, w in enumerate(("he", "she", "they", "we", "it"))}
    texts |= {7010: f"tel={number(1, 0)}; 4 {number(1, 1)} 5", 7011: "and 802.5559.999 there"}
    got = {r.doc_id: r for r in pii.find(docs(spark, rows + [(i, t, "a") for i, t in texts.items()])).collect()}
    for i, t in texts.items():
        want = [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"802\.5559\.\d\d1", t)]
        assert got[i].spans == ",".join(want), t
    assert got[7010].n_added == 2


def plain_bootstrap(texts):
    """The scored graph with dictionaries: {instance: kind} adopted, and {(pattern, instance): kind} of short ones."""
    edges = {e for t in texts for e in pii.edges_of(t or "")}
    seeds = {(i, k) for _, i, k, *_ in edges if k}
    seeded = {i for i, _ in seeds}
    graph = {}
    for pattern, instance, _, could, may, short, by_shape in edges:
        old = graph.get((pattern, instance), (0, 0, True, True))
        graph[pattern, instance] = (old[0] | could, old[1] | may, old[2] and short, old[3] and by_shape)
    bit = {k: 1 << n for n, k in enumerate(pii.KINDS)}
    adopted = {}
    while True:
        known = seeds | set(adopted.items())
        trust = {}
        for kind in pii.KINDS:
            for pattern in {p for p, _ in graph}:
                own = {i: v for (p, i), v in graph.items() if p == pattern}
                hits = [i for i, v in own.items() if (i, kind) in seeds or ((i, kind) in known and not v[3])]
                n = [i for i, v in own.items() if i in seeded or v[0] & bit[kind]]
                if len(hits) >= pii.MIN_SEEDS and len(hits) / len(n) >= pii.MIN_TRUST:
                    trust[pattern, kind] = len(hits) / len(n)
        names, score, short = {i for i, _ in known}, {}, {}
        for (pattern, instance), v in graph.items():
            for kind in pii.KINDS:
                t = trust.get((pattern, kind))
                if t and instance not in names and v[1] & bit[kind]:
                    if v[2]:
                        short[pattern, instance] = max(short.get((pattern, instance), (0, "")), (t, kind))
                    else:
                        miss, total = score.get((instance, kind), (1, 0))
                        score[instance, kind] = (miss * (1 - t), total + t)
        if not score:
            return adopted, {k: kind for k, (_, kind) in short.items()}
        best = {}
        for (instance, kind), (miss, total) in score.items():
            best[instance] = max(best.get(instance, (-1, -1, "")), (1 - miss, total, kind))
        adopted |= {i: b[2] for i, b in best.items()}


def test_graph_equals_plain_scores(spark):
    rng = random.Random(5)
    hosts = ["mail.example", "localhost", "mail.example.com"]
    things = [
        lambda: f"+1 ({rng.randint(200, 220)}) 555-{rng.randint(1000, 9999)}", lambda: f"802.5559.{rng.randint(100, 105)}", lambda: f"{rng.randint(1, 299)}.{rng.randint(1, 299)}.7.{rng.randint(1, 9)}",
        lambda: f"ann{rng.randint(1, 30)}@{rng.choice(hosts)}", lambda: f"ann{rng.randint(1, 9)} at {rng.choice(hosts)}", lambda: str(rng.randint(1, 60)), lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)),
        lambda: f"+1 ({rng.randint(200, 220)}) 555-{rng.randint(1000, 9999)} 10.{rng.randint(1, 9)}.7.{rng.randint(1, 9)}",
    ]
    leads = [["call us at"] * 4, ["reach them on", "call us at", "call us at"], ["host"] * 3, ["write to"] * 3, ["write to"], ["see page"] * 9 + ["call us at"], ["card no"] * 2, ["call us at", *["then"] * 9]]
    texts = []
    for _ in range(400):
        k = rng.randrange(len(things))
        texts.append(f"{rng.choice(['Please', 'now', 'x' * 70])} {rng.choice(leads[k])} {things[k]()} {rng.choice(['today', 'or', ''])}".strip())
    texts += [None, "", *texts[:20]]
    got = pii.bootstrap(docs(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()
    adopted, short = plain_bootstrap(texts)
    assert {r.instance: r.kind for r in got if r.pattern is None} == adopted
    assert {(r.pattern, r.instance): r.kind for r in got if r.pattern is not None} == short
    assert {"ip", "phone"} <= set(adopted.values())
    assert short


def test_parts_of_runs_are_found_by_their_shape(spark):
    rows = [(k, f"{w} +1 (802) 555-98{k:02d} {w}", "a") for k, w in enumerate("abcdefghijkl")]
    rows += [(100, "so +1 (826) 555-4081 190.137.223.204 is", "a"), (101, "so +1 (826) 555-40811 190.137.223.204 is", "a"), (102, "so 4444444444444448 5 is", "a")]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    assert (got[100].spans, got[100].n_phone, got[100].n_added) == ("phone:3:20,ip:21:36", 0, 1)
    assert got[101].n_added == got[102].n_added == 0


def test_candidates_take_linear_time():
    start = time.time()
    for text in ("1 " * 10**5, " " * 10**6 + "at" + " " * 10**6, "a at " * 10**5, "a dot " * 10**5 + "at b.c", "1." * 10**5, "a at b.c " * 10**4, "(" * 10**6):
        pii.occurrences(text, pii.base_spans(text), {1, 3, 4})
        pii.edges_of(text)
    assert time.time() - start < 60


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty).count() == 0
    assert pii.redact(empty).count() == 0
