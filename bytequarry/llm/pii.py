"""Personal data: exact patterns as seeds, and bootstrapped contextual extraction of unseen identifiers.

Emails, IPv4 addresses, card numbers and phone numbers are found by fixed
patterns. What stands around these seeds induces lexical patterns, each more
general than the next: the words of its line before it (up to four), the two
words before it, the word before or after it with its shape, the shapes of its
neighbours with its own, and its shape alone. A shape has a 9 for each digit
and one a for a run of letters. Spark scores the graph of patterns and
instances (strings that have them) in rounds, until one adopts nothing: a
pattern is trusted for a kind if many instances are known to be of it and few
that could be are not; an instance is adopted if any trusted pattern holds for
it somewhere, with the kind of the most combined trust (after Riloff and Jones,
and Thelen and Riloff). Other contexts don't count against it. Patterns of
shapes alone are judged by seeds only, so that rounds don't drift along them,
and adopt only what passes the kind's own test (parts of an address, digits,
check digit). Every occurrence of an adopted instance is marked; seeds stay as
they are.

Instances are words, spelt-out addresses (ann at mail.example, ann (at) mail
(dot) example), runs of number groups joined by spaces, dots, dashes or
brackets, and parts of such runs that pass a kind's test, which a fixed pattern
loses when its match runs on. Words with @ and spelt-out addresses can only be
emails; numbers of under 6 digits can't. Nothing tells a word or number of
under 6 digits from any other once it stands elsewhere, so it is marked after
a trusted pattern of words but never adopted. An occurrence is a word, a part of
one between signs other than @ . + % - _, a spelt-out address, or number groups
of a run, in which parts of over 64 characters aren't looked for.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, pieces, tidy, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's match takes the whole run of digits, so looking at a run's start only changes no result.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[0-9]+")
_PIECE = re.compile(r"[\w@.+%-]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D\0]+")
_GROUPS = re.compile(r"(?<!\w)\+?[0-9]++(?!\w)(?:[\x20.()\[\]-]{1,3}[0-9]++(?!\w))*+")
_AT = re.compile(r"(?<=\w)(?:\s{1,3}at\s{1,3}|(\s{0,3}[\[({<]\s{0,3}at\s{0,3}[\])}>]\s{0,3}))(?=[A-Za-z0-9])", re.I)
_DOT = r"(?:\s{1,3}dot\s{1,3}|\s{0,3}[\[({<]\s{0,3}dot\s{0,3}[\])}>]\s{0,3})"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+", re.I)
_DOT_BEFORE = re.compile(rf"{_DOT}$", re.I)
_WORDS = re.compile(r"\w+")
_NEWLINE = re.compile(r"[\n\r]")
SHAPE = "shape "
_EDGE = ".,;:!?\"'()[]{}<>"

#: Seeds of one kind that a trusted pattern has at least, distinct; its share of known instances.
MIN_SEEDS = 5
MIN_TRUST = 0.8
#: A string with so many digits is an identifier by itself. Longer strings and patterns move as hashes.
MIN_DIGITS, MAX_CHARS = 6, 64
LINE_WORDS = 4  # words before an instance on its line that make a pattern of the line
#: Forms of instances: address, short number, short word, many digits. Adopted are those of TELLING forms.
ADDRESS, NUMBER, WORD, DIGITS = range(4)
TELLING = (ADDRESS, DIGITS)
#: Kinds, as bits, that strings of a form can be of.
COULD = {ADDRESS: 1, NUMBER: 14, WORD: 15, DIGITS: 15}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards, so that long words cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1  # no later match reaches back over this @
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _name(instance: str) -> str:
    """The instance itself, or the hash of a long one."""
    return instance if len(instance) <= MAX_CHARS else "sha256:" + hashlib.sha256(instance.encode("utf-8", "surrogatepass")).hexdigest()


def _n_digits(text: str) -> int:
    return sum(c in string.digits for c in text)


def spelt_addresses(text: str) -> list[tuple[int, int]]:
    """Places of addresses with at for @: the host has a dot (or dot, spelt), unless at is in brackets."""
    out, end = [], 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if m.start() <= end or not host or not (m[1] or re.search(rf"\.|{_DOT}", host[0], re.I)):
            continue
        a = m.start()
        while True:
            while a > end and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
                a -= 1
            dot = _DOT_BEFORE.search(text, max(end, a - 15), a)
            if not dot or dot.start() <= end or not text[dot.start() - 1].isalnum():
                break
            a = dot.start()
        if a < m.start():
            out.append((a, host.end()))
            end = host.end()
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, form) of strings outside the spans that may be identifiers, less signs at their edges.

    These are words with a digit or @, runs of number groups, and spelt-out
    addresses. What lies inside another of them counts if it has many digits.
    """
    out, end, parts = {}, 0, []
    for a, _, b in spans:
        if b > end:
            parts += [text[end:a], "\0" * (b - max(a, end))]
            end = b
    free = "".join([*parts, text[end:]]) if spans else text
    whole = [(a, b, ADDRESS) for a, b in spelt_addresses(free)]
    digits = _DIGIT.search(free)
    if digits:
        whole += [(m.start(), m.end(), NUMBER) for m in _GROUPS.finditer(free)]
    if digits or "@" in free:
        for m in _TOKEN.finditer(free):
            word = m[0]
            if "@" not in word and not (digits and _DIGIT.search(word)):
                continue
            a = m.start() + len(word) - len(word.lstrip(_EDGE))
            b = m.end() - (len(word) - len(word.rstrip(_EDGE)))
            if a < b and any(c.isalnum() for c in free[a:b]):
                whole.append((a, b, ADDRESS if "@" in word else WORD))
    top = 0
    for a, b, form in sorted(whole, key=lambda w: (w[0], -w[1], w[2])):
        many = _n_digits(free[a:b]) >= MIN_DIGITS
        if b > top or many:
            out.setdefault((a, b), DIGITS if many else form)
        top = max(top, b)
    return [(a, b, form) for (a, b), form in out.items()]


def passes(text: str) -> int:
    """Kinds, as bits, whose fixed pattern takes the whole of the text and whose test it passes."""
    bits = 0
    for a, k, b in base_spans(text):
        if a == 0 and b == len(text):
            bits |= 1 << k
    return bits


def parts_of_runs(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of number groups within longer runs of candidates that pass a kind's test.

    An address has four groups, a phone number up to 15, a card number up to 19,
    so each group starts 19 parts at most.
    """
    out = {}
    for a, b, form in found:
        if form != DIGITS:
            continue
        for run in _GROUPS.finditer(text, a, b):
            numbers = [m.span() for m in _NUMBERS.finditer(text, *run.span())]
            for k, (x, _) in enumerate(numbers):
                x -= x > 0 and text[x - 1] == "+"
                n = 0
                for y, z in numbers[k : k + 19]:
                    n += z - y
                    if n > 19:
                        break
                    if n >= 4 and (x, z) != run.span() and (bits := passes(text[x:z])):
                        out[x, z] = out.get((x, z), 0) | bits
    return [(x, z, bits) for (x, z), bits in out.items()]


def shape(text: str) -> str:
    """The text with 9 for each digit and one a for a run of letters."""
    return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "9", text))


def _outline(word: str) -> str:
    """Letter case and digits of a neighbouring word."""
    if not word:
        return "^"
    return "9" if word.isdigit() else "A" if word.isupper() else "Aa" if word[0].isupper() else "a" if word.isalpha() else "a9"


class Places:
    """Words and line starts of a text, found once, and the patterns of places in it."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORDS.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.lines = [m.start() for m in _NEWLINE.finditer(text)]

    def _before(self, a: int, k: int) -> list[str]:
        """The k words before a place, fewer at the text's start; a word that reaches over it counts as far as it."""
        i = bisect_left(self.starts, a)
        return [self.text[self.starts[j] : min(self.ends[j], a)] for j in range(max(0, i - k), i)]

    def _after(self, b: int) -> str:
        i = bisect_left(self.ends, b + 1)
        return self.text[max(self.starts[i], b) : self.ends[i]] if i < len(self.ends) else ""

    def words(self, a: int, b: int) -> list[str]:
        """Patterns that hold words, most special first."""
        own, two, after = shape(self.text[a:b]), self._before(a, 2), self._after(b)
        last = two[-1].lower() if two else "^"
        line = self.lines[k - 1] if (k := bisect_left(self.lines, a)) else -1
        first, i = bisect_left(self.starts, line), bisect_left(self.starts, a)
        out = [f"2 {' '.join(['^'] * (2 - len(two)) + [w.lower() for w in two])}", f"1 {last} {own}", f"+ {own} {after.lower() or '^'}"]
        if 0 < i - first <= LINE_WORDS:
            out.append(f"line {' '.join(self._before(a, i - first)).lower()}")
        return [_name(x) for x in out]

    def shapes(self, a: int, b: int) -> list[str]:
        """Patterns of shapes alone."""
        own, before = shape(self.text[a:b]), self._before(a, 1)
        return [_name(f"{SHAPE}{own}"), _name(f"{SHAPE}{_outline(before[0] if before else '')} {own} {_outline(self._after(b))}")]


def edges_of(text: str) -> list[tuple[str, str, str | None, int, int, bool, bool]]:
    """(pattern, instance, kind, could, may, short, by shape) of a text's seeds and, with null kinds, candidates.

    could: kinds, as bits, that the instance counts against if it isn't known to
    be of them; may: kinds that the pattern can adopt it for.
    """
    spans = base_spans(text)
    found = candidates(text, spans)
    if not spans and not found:
        return []
    at, out = Places(text), []
    for a, k, b in spans:
        name = _name(text[a:b])
        out += [(p, name, KINDS[k], 15, 15, False, False) for p in at.words(a, b)]
        out += [(p, name, KINDS[k], 15, 15, False, True) for p in at.shapes(a, b)]
    for a, b, form in found:
        name, short, own = _name(text[a:b]), form not in TELLING, passes(text[a:b]) if form in TELLING else 0
        out += [(p, name, None, COULD[form], COULD[form], short, False) for p in at.words(a, b)]
        out += [(p, name, None, COULD[form], own, short, True) for p in at.shapes(a, b)]
    for a, b, bits in parts_of_runs(text, found):
        out += [(p, _name(text[a:b]), None, bits, bits, False, True) for p in at.shapes(a, b)]
    return out


_EDGE_COLUMNS = {"pattern": pa.string(), "instance": pa.string(), "kind": pa.string(), "could": pa.int32(), "may": pa.int32(), "short": pa.bool_(), "by_shape": pa.bool_()}


def _edges(batches):
    """Rows of ``edges_of``, once for each of a run's."""
    for batch in batches:
        for part in pieces(batch, "text"):
            out = list({e for text in part.column("text").to_pylist() if text for e in edges_of(text)})
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _EDGE_COLUMNS.values(), strict=True)], names=list(_EDGE_COLUMNS))
    tidy()


def bootstrap(docs: DataFrame, text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(pattern, instance, kind): identifiers that fixed patterns miss, anywhere (null) or after a pattern only.

    Edges are counted distinct before they move, so a frequent context is a key
    of one row a task and instance. Each round is written. A pattern's share only
    grows, so the rounds end; ``rounds`` may stop them earlier.
    """
    edges = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_edges, "pattern string, instance string, kind string, could int, may int, short boolean, by_shape boolean")
    edges = written(edges.distinct(), "edges")
    seeds = edges.where("kind is not null").select("instance", "kind", F.lit(True).alias("is_seed")).distinct()
    graph = edges.groupBy("pattern", "instance").agg(F.bit_or("could").alias("could"), F.bit_or("may").alias("may"), F.min("short").alias("short"), F.min("by_shape").alias("by_shape"))
    graph = written(graph.join(seeds.select("instance", F.lit(True).alias("seed")).distinct(), "instance", "left"), "graph")
    bit = {k: F.lit(1 << i) for i, k in enumerate(KINDS)}
    # What could be of a kind, or is a seed of any, counts for a pattern's share.
    total = graph.groupBy("pattern").agg(*(F.count_if(F.col("seed") | (F.col("could").bitwiseAND(b) != 0)).alias(f"n_{k}") for k, b in bit.items()))
    n = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"n_{k}")) for k in KINDS))
    may = F.col("may").bitwiseAND(F.coalesce(*(F.when(F.col("kind") == k, b) for k, b in bit.items()))) != 0
    known, adopted, done = seeds, None, 0
    while True:
        by_kind = graph.join(known, "instance").where("is_seed or not by_shape").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        trust = by_kind.where(F.col("hits") >= MIN_SEEDS).join(total, "pattern").withColumn("trust", F.col("hits") / n).where(F.col("trust") >= MIN_TRUST)
        trust = written(trust.select("pattern", "kind", "trust"), "patterns")
        side = F.broadcast(trust) if fits_broadcast(trust, 300) else trust
        follows = graph.join(known, "instance", "left_anti").join(side, "pattern").where(may)
        if rounds is not None and done >= rounds:
            break
        score = follows.where("not short").groupBy("instance", "kind").agg((1 - F.product(1 - F.col("trust"))).alias("combined"), F.sum("trust").alias("sum"))
        fresh = written(score.groupBy("instance").agg(F.max(F.struct("combined", "sum", "kind"))["kind"].alias("kind")), "instances")
        if not fresh.limit(1).count():
            break
        adopted = fresh if adopted is None else written(adopted.union(fresh), "adopted")
        known, done = seeds.union(adopted.withColumn("is_seed", F.lit(False))), done + 1
    short = follows.where("short").groupBy("pattern", "instance").agg(F.max(F.struct("trust", "kind"))["kind"].alias("kind"))
    if adopted is None:
        return short
    return adopted.select(F.lit(None).cast("string").alias("pattern"), "instance", "kind").union(short)


def occurrences(text: str, spans: list[tuple[int, int, int]], sizes: set[int]) -> list[tuple[int, int, bool]]:
    """(start, end, whether only patterns tell) of all places where instances may stand; runs of ``sizes`` numbers within runs."""
    found = candidates(text, spans)
    out = {(a, b): form not in TELLING for a, b, form in found}
    for a, b, _ in found:
        word = text[a:b]
        for m in _PIECE.finditer(word):
            x = a + m.end() - len(m[0].lstrip(_EDGE))
            y = a + m.start() + len(m[0].rstrip(_EDGE))
            if x < y and ("@" in text[x:y] or _n_digits(text[x:y]) >= MIN_DIGITS):
                out[x, y] = False
        if not sizes:
            continue
        for run in _GROUPS.finditer(word):
            numbers = [m.span() for m in _NUMBERS.finditer(word, run.start(), run.end())]
            for k, (x, _) in enumerate(numbers):
                for size in sizes:
                    if k + size > len(numbers):
                        continue
                    y = numbers[k + size - 1][1]
                    for z in (x, x - 1) if x and word[x - 1] == "+" else (x,):
                        if y - z <= MAX_CHARS and _n_digits(word[z:y]) >= MIN_DIGITS:
                            out[a + z, a + y] = False
    return [(a, b, short) for (a, b), short in sorted(out.items())]


_SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _places(sizes: set[int], shorts: bool):
    """Function for (tkey, text): where instances may stand, with their patterns if only these tell (and ``shorts`` are wanted)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for key, text in zip(part.column("tkey").to_pylist(), part.column("text").to_pylist(), strict=True):
                    at = None
                    for a, b, short in occurrences(text, base_spans(text), sizes):
                        if short and shorts:
                            at = at or Places(text)
                            out += [(key, p, _name(text[a:b]), a, b) for p in at.words(a, b)]
                        elif not short:
                            out.append((key, "", _name(text[a:b]), a, b))
                if out:
                    kinds = [pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["tkey", "pattern", "instance", "start", "end"])
        tidy()

    return run


def added_spans(docs: DataFrame, text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(tkey, added): spans that bootstrapping adds to the texts with this MD5."""
    # A pattern is never empty, so that stands for anywhere.
    found = written(bootstrap(docs, text_col, rounds).withColumn("pattern", F.coalesce("pattern", F.lit(""))), "found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))
    some = found.agg(F.count("*"), F.count_if(F.col("pattern") != "")).first()
    if not some[0]:
        return keyed.select("tkey", F.array().cast(f"array<{_SPAN}>").alias("added")).limit(0)
    # Numbers in an adopted instance: few values, as longer instances are hashes and not looked for within runs.
    sizes = found.where("pattern = '' and instance not like 'sha256:%' and instance not rlike '[A-Za-z@]'")
    sizes = {r[0] for r in sizes.select(F.size(F.regexp_extract_all("instance", F.lit("[0-9]+"), F.lit(0)))).distinct().collect()}
    places = keyed.mapInArrow(_places(sizes, some[1] > 0), "tkey binary, pattern string, instance string, start bigint, end bigint")
    side = F.broadcast(found) if some[0] * 300 <= 32 << 20 else found
    hits = places.join(side, ["pattern", "instance"])
    return written(hits.groupBy("tkey").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")), "added")


def _all_spans(base: list[tuple[int, int, int]], added: list | None) -> list[tuple[int, int, int]]:
    """The fixed patterns' spans and those added ones that lie inside no other added one."""
    out, top = {*base}, 0
    for a, b, k in sorted(((s["start"], s["end"], KINDS.index(s["kind"])) for s in added or []), key=lambda x: (x[0], -x[1], x[2])):
        if b > top:
            out.add((a, k, b))
            top = b
    return sorted(out)


_DIGEST = {"doc_id": pa.int64(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}


def _digest(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            out = []
            for doc, text, added in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "added")), strict=True):
                base = base_spans(text)
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                more = _all_spans(base, added)
                out.append((doc, *n, hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in more), len(more) - len(base)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _DIGEST.values(), strict=True)], names=list(_DIGEST))
    tidy()


def _with_added(docs: DataFrame, text: Column, added: DataFrame) -> DataFrame:
    """Rows with the spans added to their texts; the documents stay in place unless those are very many."""
    size = added.agg(F.sum(64 + 48 * F.size("added"))).first()[0] or 0
    key = F.unhex(F.md5(text))
    added = added.select(F.col("tkey").alias("_bq_key"), F.col("added").alias("_bq_added"))
    return docs.join(F.broadcast(added) if size <= 32 << 20 else added, key == F.col("_bq_key"), "left")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    The counts and the digest are of the fixed patterns; spans lists these and
    the added ones as kind:start:end in characters, by start and kind.

    Null and empty texts have no spans; repeated rows each have theirs; an empty
    table gives no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _with_added(rows, text, added_spans(docs, text_col)).select("doc_id", text.alias("text"), F.col("_bq_added").alias("added"))
    return rows.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _masked(text: str, added: list) -> str:
    spans = _all_spans(base_spans(text), added)
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns with every span replaced by its kind in angle brackets, overlapping spans by the first's.

    ``chars_col``, if there, is set to the new length. Null texts stay null,
    empty ones empty. Repeated rows each stay; an empty table gives no rows;
    other columns pass as they are, whatever their names.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array, added: pa.Array) -> pa.Array:
        rows, out = pa.record_batch([texts, added], names=["text", "added"]), []
        for part in pieces(rows, "text"):
            out.append(pa.array([None if t is None else _masked(t, a) for t, a in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    text = F.col(text_col).cast("string")
    rows = _with_added(docs, F.coalesce(text, F.lit("")), added_spans(docs, text_col))
    out = rows.withColumn(text_col, masked(text, F.col("_bq_added"))).select(*docs.columns)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out
