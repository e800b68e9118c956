"""Token output: concatenate-and-cut packing and best-fit-decreasing packing.

Texts become ids inside tasks, a batch at a time. Both packers leave the ids
where they were made: concatenation needs only each partition's token total, and
best fit packs blocks of documents that lie together, so no id is shuffled.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces as runs
from .common import tidy, written

#: Words, and letter runs, that a task remembers with their ids; later new ones are encoded each time.
CACHE_WORDS, CACHE_UNITS = 100_000, 150_000
#: Words of these characters lower-case letter by letter and are their own NFC form, and the
#: tokenizer's pattern cuts them into runs of letters, single digits and runs of other signs.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Ids (little-endian uint32 bytes) by space-separated word, for tokenizers that drop white space.

    Space and newline always end a token of such a tokenizer and are in none, so
    a text's ids are its words' ids in order. A new word of plain characters is
    cut as the tokenizer would cut it, for rare words share their letter runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.units = Tokenizer.from_file(path), {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, piece: str) -> bytes:
        """Ids of what the tokenizer's pattern would cut out, without its normalizer and pattern."""
        letters = self.letters
        return np.array([t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))], "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        pieces = _PLAIN.findall(word)
        if sum(map(len, pieces)) != len(word) or "<|" in word:
            ids = self._encode(word)
        else:
            out = []
            for piece in pieces:
                piece = piece.lower()
                unit = self.units.get(piece)
                if unit is None:
                    unit = self._unit(piece)
                    if len(self.units) < CACHE_UNITS:
                        self.units[piece] = unit
                out.append(unit)
            ids = b"".join(out)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(m in text for m in self.marks) and any(" " in m or "\n" in m for m in self.marks):
            return self._encode(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table for each worker process, until the task that uses it ends."""
    return WordIds(path)


def _drop_table() -> None:
    """An idle worker keeps no table: many may be idle while others work."""
    word_ids.cache_clear()
    tidy()


def _tokens(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table, part, before = word_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in runs(batch, "text"):
                ids = [table.ids(t or "") + end for t in rows.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "n", "ids"])
        del table
        _drop_table()

    return run


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, start, n, ids): each row's ids with ``end_id`` as uint32 bytes, and where they start in their partition."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokens(tokenizer_path, end_id), "doc_id long, part int, start long, n long, ids binary")


def _cut(length: int):
    """Cut (doc_id, at, ids) at multiples of ``length``, a few rows at a time: pieces leave as they are made."""

    def run(batches):
        for batch in batches:
            for part in runs(batch, "ids"):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
                for doc, at, ids in zip(*(part.column(c).to_pylist() for c in ("doc_id", "at", "ids")), strict=True):
                    own = np.frombuffer(ids, "<u4")
                    a = 0
                    while a < len(own):
                        b = min(len(own), a + length - (at + a) % length)
                        piece = ids[4 * a : 4 * b]
                        for name, v in zip(out, (doc, a, b - a, zlib.crc32(piece), len(own), (at + a) // length, (at + a) % length, piece), strict=True):
                            out[name].append(v)
                        a = b
                yield pa.record_batch([pa.array(v, pa.binary() if name == "ids" else pa.int64()) for name, v in out.items()], names=list(out))
        tidy()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids in sequences of ``length``: all ids in one row, cut into windows.

    First pass: tokenize, with each document's place in its partition, and write
    that. Second pass: prefix sums over the partitions' totals (one row each)
    give every document its global place; a document that a window's end cuts
    yields one row on either side of it. ``ids`` holds the piece as uint32 bytes.

    Null and empty texts have the end id alone. Rows are placed in the order in
    which the table is read; repeated rows are placed each. Only the last
    sequence can be short. An empty table gives no rows.
    """
    ids = written(token_table(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # One row a partition, so this window is as small as the list of tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    placed = ids.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length), PIECES + ", ids binary")


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, cu_seqlens, position_ids) of packed pieces; ids are padded to ``length``.

    At most ``length`` pieces meet in a row, whatever the data.
    """
    return pieces.groupBy("sequence_id").applyInArrow(_assemble(length, pad_id), "sequence_id long, ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>")


def _matrix_row(parts, length, pad_id):
    """ids, cumulative lengths and positions of [(start, ids)], padded; positions restart with each piece."""
    row, pos, cu, at = np.full(length, pad_id, np.int32), np.zeros(length, np.int32), [0], 0
    for ids in parts:
        row[at : at + len(ids)] = ids
        pos[at : at + len(ids)] = np.arange(len(ids))
        at += len(ids)
        cu.append(at)
    return row, np.array(cu, np.int32), pos


def _assemble(length, pad_id):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        parts = [np.frombuffer(x, "<i4") for x in table.column("ids").to_pylist()]
        row, cu, pos = _matrix_row(parts, length, pad_id)
        return pa.table({"sequence_id": [table.column("sequence_id")[0].as_py()], "ids": [row], "cu_seqlens": [cu], "position_ids": [pos], "doc_ids": [table.column("doc_id").to_pylist()]}, schema=_ROWS)

    return run


_ROWS = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


class Capacities:
    """Segment tree over remaining capacities 0..length: the smallest that still holds a piece."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the smallest capacity >= need."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        bin_no = self.bins[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, bin_no


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest pieces first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    open_bins = Capacities(capacity)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_bins.take(lengths[i])
        if found is None:
            bins.append([])
            found = capacity, len(bins) - 1
        bins[found[1]].append(i)
        open_bins.add(found[0] - lengths[i], found[1])
    return bins


def id_bytes(path: str, end_id: int, pad_id: int, length: int) -> int:
    """Bytes of a stored id or position: 2 if all fit, else 4."""
    return 2 if max(word_ids(path).tokenizer.get_vocab_size(), end_id + 1, pad_id + 1, length) <= 1 << 16 else 4


def _pack(path: str, end_id: int, length: int, block_tokens: int, pad_id: int):
    tokens = _tokens(path, end_id)
    kinds = {"sequence_id": pa.int64(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "position_ids": pa.binary(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "id_bytes": pa.int32()}

    def emit(part, number, pieces, size):
        bins = best_fit_decreasing([len(x) for *_, x in pieces], length)
        for at in range(0, len(bins), 64):
            out = {k: [] for k in kinds}
            for k, members in enumerate(bins[at : at + 64], at):
                row, cu, pos = _matrix_row([pieces[i][2] for i in members], length, pad_id)
                values = ((part << 40) + number + k, row.astype(f"<u{size}").tobytes(), cu, pos.astype(f"<u{size}").tobytes(), [pieces[i][0] for i in members], [pieces[i][1] for i in members], size)
                for name, v in zip(kinds, values, strict=True):
                    out[name].append(v)
            yield len(out["ids"]), pa.record_batch([pa.array(v, kinds[k]) for k, v in out.items()], names=list(kinds))

    def run(batches):
        part, pieces, held, number = TaskContext.get().partitionId(), [], 0, 0
        size = id_bytes(path, end_id, pad_id, length)
        for batch in tokens(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i4")
                for a in range(0, len(own), length):
                    pieces.append((doc, a, own[a : a + length]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        base = number
                        for rows, out in emit(part, base, pieces, size):
                            number += rows
                            yield out
                        pieces, held = [], 0
        if pieces:
            for _, out in emit(part, number, pieces, size):
                yield out

    return run


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, block_tokens: int = 4 << 20, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed id matrices: (sequence_id, ids, cu_seqlens, position_ids, doc_ids, starts, id_bytes).

    ids and position_ids are matrix rows of ``length`` little-endian unsigned
    numbers of id_bytes bytes each: numpy.frombuffer(row.ids, f"<u{row.id_bytes}").

    A document longer than ``length`` is split into pieces of that length and a
    rest, so no id is lost. Blocks of about ``block_tokens`` tokens that are read
    together are packed by best-fit-decreasing, in memory and without a shuffle.
    A block makes a thousand full sequences and a few short ones. cu_seqlens are a row's
    cumulative piece lengths; position_ids restart at 0 with every piece and are
    0 in the padding, which starts at the last cumulative length.

    Null and empty texts have the end id alone; repeated rows are packed each;
    an empty table gives no rows. Sequence ids are unique, not consecutive.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, end_id, length, block_tokens, pad_id), "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, id_bytes int")
