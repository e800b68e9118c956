"""Phrase collocations: candidates from sketch bounds, exact counts by Aho-Corasick scans, lowest-cut scores.

A phrase can't occur more often than its words, than the pairs of words in it,
or than the cell of a sketch that it is hashed into. Words are counted exactly,
and texts are written once more as numbers of their words; pairs of frequent
words, then runs of frequent pairs, are counted by cell. What all of these
bounds allow is a candidate. Candidates belong to groups by their first pair.
Of each text a group gets the stretches where its candidates may lie, and scans
these with automata of its own candidates, guarded on both sides, for all of
their overlapping occurrences. So a text isn't scanned more often as candidates
grow in number. Thresholds apply to these exact sums.

Which cells are frequent goes to tasks as a bitmap: where cells share a bit the
bound gets weaker, and nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _K1, lower_ascii, mix64, ngrams, slices, stretches, tidy, word_hashes, words, written

#: Bytes that end a piece; space and tab part the words of one.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
LETTER = ~BREAK
LETTER[[0x20, 0x09]] = False
#: Bytes of text that a task looks at together.
LOOK_BYTES = 4 << 20
#: Bits of the bitmap of frequent cells: one for eight cells, between 8 and 64 MB.
LEAST_BITS, MOST_BITS = 1 << 26, 1 << 29
LEAST_CELLS = 1 << 24
#: Letters of candidates in one automaton; further ones of a group go to further automata.
AUTOMATON_LETTERS = 4 << 20
#: Signs of stretches that a task holds before it scans them.
STRETCHES = 64 << 20
#: Words of coded text that a task looks at together; cells that it counts before it gives them; words of looks that it holds.
CODED, COUNTED, HELD = 1 << 20, 1 << 22, 2_000_000
#: Words of the corpus for each part of a sketch.
PART_WORDS = 8_000_000
#: Signs of a code's first place and of its others; no sign is in both, so a phrase is only found where a word begins.
SIGNS, FIRST, OTHER = 47, 0x50, 0x21


class Runs:
    """Words of pieces by place: their hashes, and where each word's piece ends."""

    hash: np.ndarray
    end: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all runs of n words within pieces."""
        at = np.flatnonzero(np.arange(len(self.end)) + n <= self.end)
        return at, mix64(ngrams(self.hash, n)[at] + np.uint64(n)) if len(at) else np.zeros(0, np.uint64)

    def allowed(self, most: int, pairs: np.ndarray, longer: np.ndarray | None, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) for n from 2 to ``most``: runs of n words that the bounds of pairs and of longer runs, if given, allow.

        The first and the last n - 1 words of an allowed run are allowed too.
        """
        at = np.flatnonzero(np.arange(len(self.end)) + 2 <= self.end)
        g = mix64(self.hash[at] * _K1 + self.hash[at + 1]) if len(at) else np.zeros(0, np.uint64)
        for n in range(2, most + 1):
            if n > 2:
                before = np.zeros(len(self.end) + 1, bool)
                before[at] = True
                keep = before[at + 1]
                at, g = at[keep], g[keep]
                g = mix64(g * _K1 + self.hash[at + n - 1])
            h = mix64(g + np.uint64(n))
            if n == 2 or longer is not None:
                ok = _held(pairs if n == 2 else longer, h, cells)
                at, g, h = at[ok], g[ok], h[ok]
            yield n, at, h


class Look(Runs):
    """Words of a slice: their places, hashes (with the language's), and where each word's piece ends."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, langs: list[str]):
        self.low = lower_ascii(buf)
        self.s, self.e, first = words(self.low, offs, LETTER)
        self.langs = sorted(set(langs))
        number = {g: k for k, g in enumerate(self.langs)}
        number = np.array([number[g] for g in langs], np.int64)
        self.lang = np.repeat(number, np.diff(first))
        self.byte_lang = np.repeat(number, np.diff(offs)) if len(self.langs) > 1 else None
        n = len(self.s)
        new = np.ones(n, bool)
        if n:
            piece = np.cumsum(BREAK[self.low], dtype=np.int32)[self.s]
            new[1:] = piece[1:] != piece[:-1]
            new[first[:-1][first[:-1] < n]] = True
        start = np.flatnonzero(new)
        self.end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n])) if n else start

    @cached_property
    def hash(self) -> np.ndarray:
        seed = np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in self.langs], np.uint64)
        return mix64(word_hashes(self.low, self.s, self.e) + seed[self.lang]) if len(self.s) else np.zeros(0, np.uint64)


class Coded(Runs):
    """Coded texts: numbers of their frequent words, 0 where a piece ends and for other words, which end a piece as well."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        gap = np.flatnonzero(ids == 0)
        self.end = np.repeat(gap, np.diff(np.r_[-1, gap]))
        self.hash = mix64(ids.astype(np.uint64))


def _held(bits: np.ndarray, h: np.ndarray, cells: int) -> np.ndarray:
    at = (h & np.uint64(min(cells, 8 * len(bits)) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def looks(batches):
    """Looks at about LOOK_BYTES of texts each, of one language where there are so many of it; a longer text is cut where a piece ends."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))
        lang = batch.column(0)
        for lo, hi, buf, offs in slices(batch.column(1), LOOK_BYTES):
            langs = lang[lo:hi].to_pylist()
            if hi - lo > 1 or len(buf) <= 2 * LOOK_BYTES:
                yield Look(buf, offs, langs)
            else:
                for a, b in stretches(buf, BREAK, LOOK_BYTES):
                    yield Look(buf[a:b], np.array([0, b - a]), langs)
    tidy()


def _strings(data, size: np.ndarray) -> pa.Array:
    """Byte strings of the given sizes that lie one after another."""
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size, dtype=np.int64)]), pa.py_buffer(data)])


def _places(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each string begins, with the last one's end) of byte strings."""
    _, offs, data = strings.buffers()
    at = np.frombuffer(offs, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _coded(batches):
    """Texts by look and language, word for word: rows (lang, words, their sizes, how often each occurs, codes of two or four bytes: places in words)."""
    for look in looks(batches):
        for k, lang in enumerate(look.langs):
            text = np.frombuffer(guarded(look, k).encode(), np.uint8)
            if len(text):
                # Words and line ends follow spaces, and hold none.
                space = text == 0x20
                coded = _strings(text[~space], np.diff(np.r_[np.flatnonzero(space), len(text)]) - 1).dictionary_encode()
                code, (data, at) = coded.indices.to_numpy(), _places(coded.dictionary)
                kind = np.uint16 if len(at) <= 1 << 16 else np.uint32
                row = data[at[0] : at[-1]], np.diff(at).astype(np.uint32), np.bincount(code).astype(np.uint32), code.astype(kind)
                yield pa.record_batch([pa.array([lang], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["lang", "words", "sizes", "n", "codes"])


def _vocabularies(batches, first: int = 0):
    """(row, words, counts) of the rows of packed words whose columns begin at ``first``: words, sizes, counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            word, size, n = (batch.column(first + c)[i].as_buffer() for c in range(3))
            yield batch.slice(i, 1), _strings(word, np.frombuffer(size, np.uint32)), np.frombuffer(n, np.int64 if first > 1 else np.uint32)


def _summed(held: list[tuple[str, pa.Array, np.ndarray]]) -> pa.Table:
    """(lang, word, n) of words, each once."""
    rows = [pa.table({"lang": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(word), np.int32)), pa.array([lang], pa.string())).cast(pa.string()), "word": word, "n": pa.array(n, pa.int64())}) for lang, word, n in held]
    return pa.concat_tables(rows).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"]).combine_chunks()


def _words(parts: int):
    """Words of coded texts and their counts, packed by part: rows (part, lang, words, sizes, counts)."""

    def packed(held):
        rows = _summed(held)
        data, at = _places(word := rows["word"].chunk(0))
        lang = rows["lang"].chunk(0).dictionary_encode()
        key = (word_hashes(data, at[:-1], at[1:]) % np.uint64(parts)).astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        (data, at), n = _places(word.take(pa.array(order))), rows["n"].chunk(0).to_numpy()[order]
        key, lo = np.unique(key[order], return_index=True)
        cut = [(data[at[x] : at[y]], np.diff(at[x : y + 1]).astype(np.uint32), n[x:y]) for x, y in zip(lo.tolist(), [*lo[1:].tolist(), len(order)], strict=True)]
        part, number = np.divmod(key, len(lang.dictionary))
        return pa.record_batch([pa.array(part, pa.int64()), lang.dictionary.take(pa.array(number)), *(pa.array([x[c].tobytes() for x in cut], pa.binary()) for c in range(3))], names=["part", "lang", "words", "sizes", "counts"])

    def run(batches):
        held, size = [], 0
        for row, word, n in _vocabularies(batches, 1):
            real = pc.not_equal(word, pa.scalar(b"\n", pa.large_binary()))
            held.append((row.column(0)[0].as_py(), word.filter(real), n[real.to_numpy(zero_copy_only=False)]))
            size += len(n)
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)
        tidy()

    return run


def _frequent(least: int):
    """Rows come by part: (lang, word, n) of its words that occur ``least`` times or more, and without a word the sum of each language's words."""

    def emit(held):
        rows = _summed(held)
        total = rows.group_by("lang").aggregate([("n", "sum")])
        often = rows.filter(pc.greater_equal(rows["n"], least))
        yield pa.record_batch([often[c].combine_chunks().cast(t) for c, t in (("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()))], names=["lang", "word", "n"])
        yield pa.record_batch([total["lang"].combine_chunks(), pa.nulls(len(total), pa.binary()), total["n_sum"].combine_chunks()], names=["lang", "word", "n"])

    def run(batches):
        last, held = None, []
        for row, word, n in _vocabularies(batches, 2):
            if (part := row.column(0)[0].as_py()) != last and held:
                yield from emit(held)
                held = []
            last = part
            held.append((row.column(1)[0].as_py(), word, n))
        if held:
            yield from emit(held)
        tidy()

    return run


def _runs(batches, known: dict[str, tuple[pa.Array, int]]):
    """Coded texts with the numbers of known words, about CODED words at a time."""
    held, size = [], 0
    for row, word, _ in _vocabularies(batches, 1):
        number = np.zeros(len(word), np.int32)
        if (lang := row.column(0)[0].as_py()) in known:
            words, numbers = known[lang]
            place = pc.fill_null(pc.index_in(word, words), -1).to_numpy()
            number = np.r_[numbers, np.int32(0)][place]
        held.append(number[np.frombuffer(row.column(4)[0].as_buffer(), np.uint16 if len(word) < 1 << 16 else np.uint32)])
        size += len(held[-1])
        if size >= CODED:
            yield Coded(np.concatenate(held))
            held, size = [], 0
    if held:
        yield Coded(np.concatenate(held))
    tidy()


def _cells(known, most: int, bits, cells: int, parts: int):
    """Occurrences by cell: of all pairs, or, with the bitmap of pairs, of longer runs that it allows; packed by part: rows (part, cells, counts)."""
    kind = np.uint32 if cells <= 1 << 32 else np.uint64
    bounds = np.array([part * cells // parts for part in range(parts + 1)], np.uint64)

    def packed(held):
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.searchsorted(cell, bounds)
        rows = [(part, cell[lo:hi].tobytes(), n[lo:hi].astype(np.uint32).tobytes()) for part, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if lo < hi]
        return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "cells", "counts"])

    def run(batches):
        held, size = [], 0
        for runs in _runs(batches, known.value):
            found = [runs.grams(2)[1]] if bits is None else [h for n, _, h in runs.allowed(most, bits.value, None, cells) if n > 2]
            held += [(h & np.uint64(cells - 1)).astype(kind) for h in found]
            size += sum(map(len, found))
            if size >= COUNTED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _often(least: int, bits: int, cells: int, parts: int):
    """Rows come by part: the bits of its cells that are counted ``least`` times or more."""
    kind = np.uint32 if cells <= 1 << 32 else np.uint64

    def run(batches):
        last, total = None, np.zeros(0)

        def emit():
            cell = np.flatnonzero(total >= least) + (last or 0) * cells // parts
            return pa.record_batch([pa.array(np.unique(cell & (bits - 1)), pa.int64())], names=["bit"])

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != last:
                    yield emit()
                    last, total = part, np.zeros((part + 1) * cells // parts - part * cells // parts, np.int64)
                cell, n = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, kind), (2, np.uint32)))
                total[(cell - kind(part * cells // parts)).astype(np.int64)] += n  # a row's cells are distinct
        yield emit()

    return run


def _width(words: int) -> int:
    """Signs of a word's code."""
    width = 1
    while SIGNS**width < words:
        width += 1
    return width


def _signs(words: int) -> np.ndarray:
    """The code of each number below ``words``, a row of signs each; 0, which is no word, is line ends."""
    width, number = _width(words), np.arange(words)
    signs = np.stack([number // SIGNS**k % SIGNS + (OTHER if k else FIRST) for k in range(width)], 1).astype(np.uint8)
    signs[:1] = 0x0A
    return signs


def _joined(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of some stretches, with a 0 after each."""
    ends = np.cumsum(size + 1)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - 1, size + 1)
    return np.where(inside < np.repeat(size, size + 1), ids[np.minimum(np.repeat(start, size + 1) + inside, len(ids) - 1)], 0)


class Seen:
    """Hashes met before: as many as there is room for, so that some are met as new again."""

    def __init__(self, room: int = 1 << 20):
        self.held, self.place = np.zeros(room, np.uint64), np.zeros(room, np.int64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes not held, each that finds room once; those are held from now on."""
        slot = (h >> np.uint64(20) & np.uint64(len(self.held) - 1)).astype(np.int64)
        at = np.flatnonzero(self.held[slot] != h)
        self.held[slot[at]] = h[at]
        self.place[slot[at]] = at
        return at[(self.place[slot[at]] == at) | (self.held[slot[at]] != h[at])]


def _stretches(known, most: int, pairs, longer, cells: int, groups: int, words: int):
    """What a group's candidates are found in, and those that are there, as codes: rows (group, candidates, stretches).

    A stretch holds all allowed runs that begin in it with a pair of the group.
    Stretches of a group don't overlap.
    """

    def run(batches):
        signs = _signs(words)
        for runs in _runs(batches, known.value):
            size, group, new, seen = np.zeros(len(runs.ids), np.int64), np.zeros(len(runs.ids), np.int64), [], Seen()
            for n, at, h in runs.allowed(most, pairs.value, longer and longer.value, cells):
                size[at] = n
                if n == 2:
                    begin = at
                    group[at] = h % np.uint64(groups)
                fresh = at[seen.new(h)]
                new.append((fresh, np.full(len(fresh), n)))
            begin = begin[np.argsort(group[begin], kind="stable")]
            apart = group[begin] * (len(runs.ids) + most)
            end = np.maximum.accumulate(begin + size[begin] + apart)
            first = np.flatnonzero(np.r_[True, (begin + apart)[1:] >= end[:-1]]) if len(begin) else begin
            start, last = begin[first], np.r_[first[1:], len(begin)] - 1
            found = start, (end - apart)[last] - start if len(first) else first
            new = tuple(map(np.concatenate, zip(*new, strict=True)))
            by_group: list[dict[int, bytes]] = []
            for at, length in (new, found):
                order = np.argsort(group[at], kind="stable")
                at, length = at[order], length[order]
                code, n = signs[_joined(runs.ids, at, length)], np.cumsum(length + 1)
                ids, lo = np.unique(group[at], return_index=True)
                edge = np.r_[0, n[np.r_[lo[1:], len(at)] - 1]] if len(at) else np.zeros(1, np.int64)
                by_group.append({g: code[a:b].tobytes() for g, a, b in zip(ids.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)})
            rows = list(by_group[1])
            yield pa.record_batch([pa.array(rows, pa.int64()), *(pa.array([x.get(g, b"") for g in rows], pa.binary()) for x in by_group)], names=["part", "candidates", "stretches"])

    return run


def _sums(names, least: int, letters: int, most: int):
    """Rows come by group: (lang, phrase, size, f) of its candidates that occur ``least`` times or more.

    A row has all candidates that its stretches hold, so rows may be scanned apart: about ``most`` signs of stretches are held.
    """
    import ahocorasick

    def run(batches):
        width, part, size = _width(len(names.value[0])), None, 0
        text: list[str] = []
        total: dict[bytes, int] = {}

        def scan():
            codes = sorted(total)
            step = max(1, letters // max(map(len, codes), default=1))
            for lo in range(0, len(codes), step):
                automaton = ahocorasick.Automaton()
                for k, code in enumerate(codes[lo : lo + step]):
                    automaton.add_word(code.decode("ascii"), k)
                automaton.make_automaton()
                n = np.zeros(len(codes[lo : lo + step]), np.int64)
                for stretches in text:
                    n += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(stretches)), np.int64), minlength=len(n))
                for code, k in zip(codes[lo : lo + step], n.tolist(), strict=True):
                    total[code] += k
            text.clear()

        def emit():
            scan()
            found = []
            for code, f in total.items():
                if f >= least:
                    ids = [sum((x - (OTHER if k else FIRST)) * SIGNS**k for k, x in enumerate(code[at : at + width])) for at in range(0, len(code), width)]
                    found.append((names.value[0][ids[0]], " ".join(names.value[1][x] for x in ids), len(ids), f))
            total.clear()
            return pa.record_batch([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "size", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                if (group := batch.column(0)[i].as_py()) != part:
                    yield emit()
                    part, size = group, 0
                for code in batch.column(1)[i].as_py().split(b"\n" * width)[:-1]:
                    total.setdefault(code, 0)
                text.append(batch.column(2)[i].as_py().decode("ascii"))
                size += len(text[-1])
                if size > most:
                    scan()
                    size = 0
        yield emit()
        tidy()

    return run


def guarded(look: Look, lang: int) -> str:
    """The pieces of one language's texts: a space before each word and after a piece's last, and then a line end."""
    mine = look.lang == lang
    size = (look.e - look.s)[mine]
    last = (look.end == np.arange(len(look.s)) + 1)[mine]
    ends = np.cumsum(1 + size + 2 * last)
    letter = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    letter[ends - (1 + size + 2 * last)] = letter[ends[last] - 2] = letter[ends[last] - 1] = False
    out = np.full(len(letter), 0x20, np.uint8)
    solid = LETTER[look.low]
    out[letter] = look.low[solid if look.byte_lang is None else solid & (look.byte_lang == lang)]
    out[ends[last] - 1] = 0x0A
    return out.tobytes().decode()


def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The bits of a column ``bit`` as one bitmap: rows of 4 KB come to the driver."""
    out = np.zeros(bits // 8, np.uint8)
    rows = found.groupBy((F.col("bit") / 32768).cast("long").alias("at")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("long")).alias("held"))
    for row in rows.toLocalIterator():
        held = np.frombuffer(row["held"], np.uint8)
        out[row["at"] * 4096 : row["at"] * 4096 + len(held)] = held
    return out


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, size, f) of every run of 1 to ``most`` words that occurs ``least`` times or more, and its exact count.

    See ``collocations`` for words, pieces and nulls.
    """
    return _counted(docs, lang_col, text_col, most, least)[0]


def _counted(docs: DataFrame, lang_col: str, text_col: str, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(frequent phrases, words of each language)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("text <> ''")
    coded = written(texts.mapInArrow(_coded, "lang string, words binary, sizes binary, n binary, codes binary"), "coded")
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = coded.mapInArrow(_words(4 * shuffled), "part long, lang string, words binary, sizes binary, counts binary").repartition(shuffled, "part").sortWithinPartitions("part")
    word = written(word.mapInArrow(_frequent(least), "lang string, word binary, n long"), "words")
    total = word.where("word is null").groupBy("lang").agg(F.sum("n").alias("n"))
    often = word.where("word is not null").select("lang", F.col("word").cast("string").alias("word"), "n")
    size = int(total.agg(F.sum("n")).first()[0] or 0)
    cells = max(LEAST_CELLS, 1 << size.bit_length())
    bits = min(max(cells >> 3, LEAST_BITS), MOST_BITS)
    parts = max(shuffled, size // PART_WORDS)
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")

    # Numbers of frequent words from 1, the most frequent first: their codes are short in a file.
    named = often.orderBy(F.col("n").desc(), "lang", "word").collect()
    number: dict[str, list[int]] = {}
    for k, r in enumerate(named):
        number.setdefault(r["lang"], []).append(k + 1)
    known = {lang: (pa.array([named[k - 1]["word"].encode() for k in ks], pa.large_binary()), np.array(ks, np.int32)) for lang, ks in number.items()}
    names = context.broadcast((["", *(r["lang"] for r in named)], ["", *(r["word"] for r in named)]))
    known = context.broadcast(known)

    def sketch(pairs=None):
        cell = by_part(coded.mapInArrow(_cells(known, most, pairs, cells, 4 * parts), "part long, cells binary, counts binary"))
        return context.broadcast(_bitmap(cell.mapInArrow(_often(least, bits, cells, 4 * parts), "bit long"), bits))

    found = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    if most < 2:
        return found, total
    pairs = sketch()
    longer = sketch(pairs) if most > 2 else None
    # So many groups that the candidates of one, as far as bits tell, make one automaton.
    held = sum(int(np.bitwise_count(b.value).sum()) for b in (pairs, longer) if b)
    groups = max(4 * parts, held * most * _width(len(named) + 1) // AUTOMATON_LETTERS)
    hits = by_part(coded.mapInArrow(_stretches(known, most, pairs, longer, cells, groups, len(named) + 1), "part long, candidates binary, stretches binary"))
    hits = written(hits.mapInArrow(_sums(names, least, AUTOMATON_LETTERS, STRETCHES), "lang string, phrase string, size int, f long"), "phrases")
    for b in (known, names, pairs, longer):
        if b:
            b.destroy()
    return found.unionByName(hits), total


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words by the score of their weakest cut.

    A-Z are lower-cased; pieces end at . , ; : ! ? and U+000A to U+000D, words of a
    piece at spaces and tabs. a counts a phrase's occurrences within pieces, overlaps
    included, ``least`` or more; n the language's words. A cut into parts that occur
    l and r times scores floor(1000 a n / (l r)), exactly; the smallest counts, of
    equals the earliest. A phrase that occurs within a longer candidate as often as that
    is dropped. Order: score and a from the largest, then the phrase by its bytes.

    A null language is ``und``; null and empty texts have no words. Repeated rows
    count each. A table without frequent phrases, or without rows, gives no
    rows. Columns other than the two are not read.
    """
    found, total = _counted(docs, lang_col, text_col, most, least)
    word = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(word, lo, n), " ")
    phrase = found.where("size > 1").withColumnRenamed("f", "a")
    cut = phrase.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("size") - F.col("k")))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    whole = lambda c: f"cast({c} as decimal(18, 0))"
    cut = cut.withColumn("score", F.expr(f"({whole('a')} * {whole('n')} * cast(1000 as decimal(4, 0))) div ({whole('l')} * {whole('r')})"))
    best = cut.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrase.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: ``collocations`` in DuckDB's SQL.
PHRASE_SQL = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
 runs as (select lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as phrase from lists, range(1, {most} + 1) t(size)),
 counted as (select lang, size, phrase, count(*) as f from runs group by all having count(*) >= {least}),
 total as (select lang, sum(len(ws))::hugeint as n from lists group by lang),
 cuts as (select c.lang, c.size, c.phrase, c.f as a, l.f as l, r.f as r, n, k, (1000 * c.f::hugeint * n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, size)) as k, string_split(phrase, ' ') as ws from counted where size > 1) c
  join counted l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:c.k], ' ') join counted r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.k + 1:], ' ') join total t on t.lang = c.lang),
 best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 kept as (select * from best b where not exists (select 1 from counted c where c.lang = b.lang and c.size > b.size and 100 * c.f >= 100 * b.a and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score from kept
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {top}"""
