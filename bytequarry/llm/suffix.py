"""Removal of repeated passages: suffix arrays by two-stage sorting over shared contexts.

A string of ``length`` bytes holds at least one anchor: the leftmost smallest
hash among the windows of ``GRAM`` bytes in it. Equal strings have the same
anchor at the same place, so a string can only start twice if its anchor's
hash occurs twice. Spark finds anchors that repeat and the distinct contexts
around them (as far as strings around the anchor can reach). A context that
occurs twice is covered whole; contexts that differ meet by anchor in a suffix
array, whose adjacent common prefixes show which of their strings repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, mix64, pieces, powers, slices, written

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64((1 << 24) - 1)
#: Longer documents are looked at in overlapping parts of so many bytes.
PART_BYTES = 4 << 20
#: Bytes of contexts in one suffix array.
SORT_BYTES = 1 << 19
#: Anchors with more distinct contexts are dealt out by what the strings at some places have in common;
#: where twice as many still meet, single strings are counted.
HOT_CONTEXTS = 1024
SHARES = 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: suffix minima of one block meet prefix minima of the next."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.r_[x, pad].reshape(-1, w)
    left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, 1).ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


class Hashes:
    """Hash of any stretch of a buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), _BASE), out=self.sums[1:])
        self.inverse = powers(len(buf) + 1, _INVERSE)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, position, anchor hash, context hash) of a slice's anchors."""
    gram = length // 2
    reach = length - gram
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    h = Hashes(buf)
    at = np.arange(len(buf) - gram + 1)
    code = h.of(at, at + gram)
    low = sliding_min((code & ~_LOW) | (at.astype(np.uint64) & _LOW), reach + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(low)]
    inside = np.arange(len(low)) + length <= offs[doc + 1]
    pos = np.unique((low[inside] & _LOW).astype(np.int64))
    doc = np.searchsorted(offs, pos, "right") - 1
    lo, hi = np.maximum(offs[doc], pos - reach), np.minimum(offs[doc + 1], pos + length)
    context = mix64(h.of(lo, hi) + (pos - lo).astype(np.uint64))
    return doc, pos - offs[doc], code[pos].view(np.int64), context.view(np.int64)


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                if len(buf) <= PART_BYTES:
                    found = [anchors(buf, offs, length)]
                else:  # one long document: parts overlap by all that a context can hold on either side
                    found = []
                    for c in range(0, len(buf), PART_BYTES):
                        a, b = max(0, c - 2 * length), min(len(buf), c + PART_BYTES + 3 * length)
                        doc, pos, code, context = anchors(buf[a:b], np.array([0, b - a]), length)
                        own = (pos + a >= c - length * (c > 0)) & (pos + a < c + PART_BYTES + length)
                        found.append((doc[own], pos[own] + a, code[own], context[own]))
                doc, pos, code, context = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(found) > 1:
                    pos, first = np.unique(pos, return_index=True)
                    doc, code, context = doc[first], code[first], context[first]
                keys = batch.column(0)[lo:hi].take(pa.array(doc))
                yield pa.record_batch([pa.array(code), pa.array(context), keys, pa.array(pos)], names=["code", "context", "tkey", "pos"])

    return run


_COLUMNS = ["group", "code", "context", "twice", "pos", "before", "bytes", "tkey"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _contexts(length: int):
    """Bytes of the contexts that are wanted of a document: rows (tkey, text, wanted).

    A context goes to its anchor's group. If that is hot, its strings are dealt
    out by how far before the anchor they start: those that start within a share
    of the reach all hold the bytes between the share's ends, whose hash names
    their group. Equal strings start equally far before the anchor and hold the
    same bytes there, so they still meet.
    """
    gram = length // 2
    reach = length - gram
    step = -(-(reach + 1) // SHARES)

    def dealt(code, pos, before, text):
        for near in range(0, min(before, reach) + 1, step):
            far = min(near + step - 1, reach)
            bytes_ = text[pos - min(before, far) : pos - near + length]
            if len(bytes_) >= length:
                shared = text[pos - near : pos - far + length]
                name = hashlib.blake2b(b"%d %d " % (code, near) + shared, digest_size=8).digest()
                yield int.from_bytes(name, "big", signed=True), min(before, far), bytes_

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = (batch.column("text")[row].as_py() or "").encode()
                wanted = batch.column("wanted")[row].as_py()
                key = batch.column("tkey")[row].as_py()
                out = []
                for w in wanted:
                    pos, before = w["pos"], min(w["pos"], reach)
                    parts = dealt(w["code"], pos, before, text) if w["hot"] else [(w["code"], before, text[pos - before : pos + length])]
                    out += [(group, w["code"], w["context"], w["twice"], pos, b, bytes_, key) for group, b, bytes_ in parts]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_COLUMNS)

    return run


def _strings(length: int):
    """Every string of a row's bytes on its own: its hash, its place, and how far before the anchor it starts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data = part.column("bytes").to_pylist()
                size = np.array([len(x) for x in data])
                first, count = np.cumsum(size) - size, size - length + 1
                row = np.repeat(np.arange(len(data)), count)
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = first[row] + inside
                string = Hashes(np.frombuffer(b"".join(data), np.uint8)).of(start, start + length)
                text = np.frombuffer(b"".join(part.column("tkey").to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
                ahead = part.column("before").to_numpy()[row] - inside
                place = mix64(text[row] + mix64((part.column("pos").to_numpy()[row] - ahead).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(row)) for c in ("group", "code", "context", "twice")), pa.array(string.view(np.int64)), pa.array(place.view(np.int64)), pa.array(ahead)],
                    names=["group", "code", "context", "twice", "string", "place", "ahead"],
                )

    return run


def repeated_strings(rows: DataFrame, length: int) -> DataFrame:
    """(code, context, lo, hi), relative to the anchor, of the rows' strings that have two places, by counting.

    For groups that hold too many contexts for one suffix array. Strings are
    counted before they move, so one that very many texts hold is one row a task.
    """
    strings = written(rows.mapInArrow(_strings(length), "group long, code long, context long, twice boolean, string long, place long, ahead long"), "strings")
    counted = strings.groupBy("group", "string").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("twice").alias("twice"))
    counted = written(counted.where("a <> b or twice").select("group", "string"), "counted")
    hit = strings.join(F.broadcast(counted) if fits_broadcast(counted, 24) else counted, ["group", "string"])
    return hit.groupBy("code", "context").agg((-F.max("ahead")).alias("lo"), (length - F.min("ahead")).alias("hi"))


def suffix_order(data: bytes, valid: np.ndarray, depth: int) -> np.ndarray:
    """Valid starts in the order of their suffixes, as far as ``depth`` bytes tell, by two-stage sorting.

    A suffix is of type B if it is smaller than its successor (the suffix that
    starts one byte later), else of type A. Type B is sorted directly, bucket by
    first byte. One scan of the buckets in order then places each type-A suffix:
    its successor has been met before it, and in that order it goes to the end of
    the A part of its bucket. The scan handles a bucket at a time, and a run of
    equal bytes within it in rounds. A start whose successor isn't valid is
    sorted directly too, and goes before the scan into a merge with its bucket.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    ok = np.zeros(n + 1, bool)
    ok[valid] = True
    nxt = np.r_[t[1:], 0]
    # A run of equal bytes has the type of its last byte, which looks at a different one.
    last = np.flatnonzero(np.r_[t[1:] != t[:-1], True])
    run_end = last[np.searchsorted(last, np.arange(n))]
    type_a = (t[run_end] > nxt[run_end]) & (run_end < n - 1)
    induced = type_a & ok[:n] & ok[1:]
    # Whoever is induced needs a chain of valid starts down to a directly sorted one; the end of a context ends it.
    direct = valid[~induced[valid]]
    order = np.argsort(t[direct], kind="stable")
    direct = direct[order]
    bounds = np.searchsorted(t[direct], np.arange(257))
    key = lambda i: data[i : i + depth]
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for c in range(256):
        group = waiting.pop(c, None)
        own = direct[bounds[c] : bounds[c + 1]]
        if group is None and not len(own):
            continue
        a_part = np.concatenate(group) if group else own[:0]
        rounds = [a_part]
        while len(a_part):
            p = a_part - 1
            p = p[(a_part > 0)]
            p = p[induced[p] & (t[p] == c)]
            rounds.append(p)
            a_part = p
        a_part = np.concatenate(rounds)
        b_part = np.array(sorted(own.tolist(), key=key), np.int64)
        odd = type_a[b_part]  # type A, but sorted directly: belongs among the A part
        if odd.any():
            a_part = np.array(list(_merged(a_part.tolist(), b_part[odd].tolist(), key)), np.int64)
            extra = []
            front = b_part[odd]
            while len(front):  # runs of the byte that end at such a start
                p = front - 1
                p = p[(front > 0)]
                p = p[induced[p] & (t[p] == c)]
                extra += p.tolist()
                front = p
            if extra:
                a_part = np.array(list(_merged(a_part.tolist(), sorted(extra, key=key), key)), np.int64)
            b_part = b_part[~odd]
        entries = np.concatenate([a_part, b_part])
        out.append(entries)
        p = entries[entries > 0] - 1
        p = p[induced[p] & (t[p] > c)]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            for piece in np.split(p, np.flatnonzero(np.diff(t[p])) + 1):
                waiting.setdefault(int(t[piece[0]]), []).append(piece)
    return np.concatenate(out) if out else valid[:0]


def _merged(a: list[int], b: list[int], key):
    from heapq import merge

    return merge(a, b, key=key)


def adjacent_common(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, as far as ``depth``; the first shares 0."""
    t = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(t, (len(data) + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for step in range(0, depth, 8):
        a, b = words[order[live] + step], words[order[live - 1] + step]
        live = live[a == b]
        common[live] = step + 8
    short = np.flatnonzero(common < depth)[1:]
    for k in range(8):  # the bytes of the word that differs
        i = order[short] + common[short]
        j = order[short - 1] + common[short]
        same = (t[np.minimum(i, len(data))] == t[np.minimum(j, len(data))]) & (np.maximum(i, j) < len(data))
        short = short[same]
        common[short] += 1
    return np.minimum(common, depth)


def covered(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(code, context, from, to), relative to the anchor, of contexts with repeated strings of ``length``.

    rows: (code, context, twice, pos, bytes before the anchor, bytes, tkey). All
    strings of a context hold its anchor, so what they cover is one stretch. A
    context that occurs twice is known to be covered and serves the others only.
    """
    data = b"".join(r[5] for r in rows)
    size = np.array([len(r[5]) for r in rows])
    first = np.cumsum(size) - size
    count = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(rows)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order = suffix_order(data, first[owner] + inside, length)
    common = adjacent_common(data, order, length)
    group = np.cumsum(common < length)
    own = np.searchsorted(first, order, "right") - 1
    # The same place of the same text in two contexts is one occurrence.
    texts = {}
    text_no = np.array([texts.setdefault(r[6], len(texts)) for r in rows])
    start = np.array([r[3] - r[4] for r in rows])[own] + order - first[own]
    place = text_no[own] * np.int64(1 << 40) + start
    twice = np.array([r[2] for r in rows], bool)[own]
    lo, hi = (np.full(group.max(initial=0) + 1, v, np.int64) for v in (np.iinfo(np.int64).max, -1))
    np.minimum.at(lo, group, place)
    np.maximum.at(hi, group, place)
    many = np.zeros(len(lo), bool)
    many[group[twice]] = True
    hit = ((lo != hi) | many)[group]
    left, right = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)
    np.minimum.at(left, own[hit], (order - first[own])[hit])
    np.maximum.at(right, own[hit], (order - first[own])[hit])
    return [(rows[k][0], rows[k][1], int(left[k]) - rows[k][4], int(right[k]) + length - rows[k][4]) for k in np.flatnonzero(right >= 0)]


def _sort(length: int):
    """Rows come by (group, code, context): whole groups are gathered up to SORT_BYTES and sorted together."""

    def emit(rows):
        out = covered([r[1:] for r in rows], length)
        if out:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["code", "context", "lo", "hi"])
        return None

    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
                if row[:3] == last:
                    continue  # a copy of the text gave it too
                if held >= SORT_BYTES and row[0] != last[0]:
                    if (out := emit(rows)) is not None:
                        yield out
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6])
                last = row[:3]
        if rows and (out := emit(rows)) is not None:
            yield out

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _merge_spans(batches):
    for batch in batches:
        spans = [[{"lo": a, "hi": b} for a, b in merge([(s["lo"], s["hi"]) for s in x])] for x in batch.column("spans").to_pylist()]
        yield pa.record_batch([batch.column("tkey"), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["tkey", "spans"])


def _remove(length: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", rows=256):
                out = []
                for doc, text, copies, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copies", "spans")), strict=True):
                    data = text.encode()
                    gone = [(0, len(data))] if (copies or 1) > 1 and len(data) >= length else [(s["lo"], min(s["hi"], len(data))) for s in spans or []]
                    kept, end = [], 0
                    for a, b in gone:
                        kept.append(data[end:a])
                        end = b
                    kept = b"".join([*kept, data[end:]])
                    out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in gone]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's UTF-8 bytes less every byte of a ``length``-byte string that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (binary; cut letters may leave invalid UTF-8) and removed
    (array of byte spans). Strings are judged on the input; every occurrence
    goes, the first too; overlaps within a text count; matches end with their text.

    Null texts are empty. Texts shorter than ``length`` keep all bytes. Rows
    with the same text count as copies, whatever their ids, and lose everything
    if they are long enough. ``length`` is a multiple of 8 of at least 16.
    An empty table gives no rows; other columns aren't read.
    """
    if length < 16 or length % 8:
        raise ValueError("length: a multiple of 8, 16 at least")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select(F.unhex(F.md5("text")).alias("tkey"), "text", "doc_id")
    long = keyed.where(F.octet_length("text") >= length)
    found = written(long.select("tkey", "text").mapInArrow(_anchors(length), "code long, context long, tkey binary, pos long").withColumn("place", F.xxhash64("tkey", "pos")), "anchors")
    copies = written(long.groupBy("tkey").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "copies")

    # Anchors that occur at two places, and the distinct contexts around them.
    again = written(found.groupBy("code").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("code"), "again")
    found = written(found.join(F.broadcast(again) if fits_broadcast(again, 16) else again, "code"), "repeated")
    contexts = found.groupBy("code", "context").agg(F.min(F.struct("place", "tkey", "pos")).alias("at"), F.max("place").alias("b"))
    contexts = written(contexts.select("code", "context", "at.tkey", "at.pos", (F.col("at.place") != F.col("b")).alias("twice")), "contexts")
    differ = contexts.groupBy("code").agg(F.min("context").alias("a"), F.max("context").alias("b"), F.count("*").alias("n")).where("a <> b")
    differ = written(differ.select("code", (F.col("n") > HOT_CONTEXTS).alias("hot")), "differ")
    wanted = contexts.join(F.broadcast(differ) if fits_broadcast(differ, 16) else differ, "code")
    wanted = wanted.groupBy("tkey").agg(F.collect_list(F.struct("code", "context", "twice", "pos", "hot")).alias("wanted"))
    wanted = written(wanted.join(copies, "tkey").select("tkey", "first_id", "wanted"), "wanted")

    rows = keyed.join(wanted, (keyed.tkey == wanted.tkey) & keyed.doc_id.eqNullSafe(wanted.first_id)).select(keyed.tkey, "text", "wanted")
    rows = rows.mapInArrow(_contexts(length), "group long, code long, context long, twice boolean, pos long, before long, bytes binary, tkey binary")
    rows = written(rows, "dealt")
    # What many contexts still share goes by single strings; a group of those is one string and only counted.
    large = written(rows.groupBy("group").count().where(F.col("count") > 2 * HOT_CONTEXTS).select("group"), "large")
    side = F.broadcast(large) if fits_broadcast(large, 16) else large
    sorted_ = rows.join(side, "group", "left_anti").repartition(parts, "group").sortWithinPartitions("group", "code", "context")
    ranges = sorted_.select(*_COLUMNS).mapInArrow(_sort(length), "code long, context long, lo long, hi long")
    if large.limit(1).count():
        ranges = ranges.union(repeated_strings(rows.join(side, "group", "left_semi"), length))
    # A context that occurs twice is covered to its ends; the text's own ends cut it below.
    reach = length - length // 2
    whole = contexts.where("twice").select("code", "context", F.lit(-reach).cast("long").alias("lo"), F.lit(length).cast("long").alias("hi"))
    once = ranges.join(contexts.where("not twice").select("code", "context"), ["code", "context"], "left_semi")
    ranges = written(whole.union(once), "ranges")
    spans = found.join(ranges, ["code", "context"]).select("tkey", F.greatest(F.lit(0), F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi")).distinct()
    spans = spans.groupBy("tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = spans.mapInArrow(_merge_spans, "tkey binary, spans array<struct<lo:bigint,hi:bigint>>")
    gone = spans.join(copies.where("copies > 1").select("tkey", "copies"), "tkey", "full")
    gone = written(gone.select("tkey", "copies", F.when(F.coalesce("copies", F.lit(1)) == 1, F.col("spans")).alias("spans")), "removed")
    size = gone.agg(F.sum(32 + 16 * F.greatest(F.lit(0), F.size("spans"))), F.count("*")).first()
    out = keyed.join(F.broadcast(gone) if (size[0] or 0) <= 32 << 20 else gone, "tkey", "left").select("doc_id", "text", "copies", "spans")
    return out.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<lo:bigint,hi:bigint>>")
