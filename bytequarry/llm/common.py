"""Shared helpers: tables in the shared folder, text slices, numpy n-gram hashing.

The numpy helpers treat a slice of an Arrow text column as one byte buffer plus
document offsets, so that hashing words or byte windows costs a few array
operations per slice and not a Python step per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import drop, drop_tables, scratch, shared_dir, written

__all__ = ["drop", "drop_tables", "scratch", "shared_dir", "written"]

#: Bytes of text that the numpy helpers look at together; longer documents stand alone.
SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xFF51AFD7ED558CCD)
_K3 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x100000001B3)
_S33 = np.uint64(33)


# --- tables ---------------------------------------------------------------


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether a table, counted now, stays below ``limit`` bytes."""
    return df.count() * row_bytes <= limit


def ranges(df: DataFrame, col: str, parts: int) -> list[int]:
    """Ascending distinct bounds that cut a column of whole numbers into about ``parts`` ranges of equal counts."""
    found = df.select(F.percentile_approx(col, [k / parts for k in range(1, parts)] or [0.5], 10000)).first()[0]
    return sorted(set(found or []))


def below(col: Column, bounds: list[int]) -> Column:
    """How many of ascending bounds are smaller than a number; 0 for null. Two looks, at about the root of their count each."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    numbers = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    smaller = lambda x: F.coalesce(F.size(F.filter(x, lambda v: v < col)), F.lit(0))
    if len(blocks) == 1:
        return smaller(numbers(blocks[0]))
    block = F.greatest(smaller(numbers([b[0] for b in blocks])) - 1, F.lit(0))
    return F.when(col.isNull(), 0).otherwise(block * step + smaller(F.get(F.array(*(numbers(b) for b in blocks)), block)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D."""
    parts = F.split(F.translate(col, "\t\n\x0b\x0c\r", "     "), " ")
    return F.size(F.array_remove(parts, "")).cast("long")


# --- slices of a batch --------------------------------------------------------


def pieces(batch: pa.RecordBatch, *sized: str, rows: int = 512, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows, of at most ``rows`` rows and about ``limit`` bytes in the columns named.

    A row of more bytes stands alone. What a task makes of a run stays within a
    small multiple of this, and below the 2 GB of an array with 32-bit offsets.
    """
    size = np.zeros(batch.num_rows, np.int64)
    for name in sized:
        size += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tidy() -> None:
    """Give memory that this worker holds but doesn't use back to the machine; called at a task's end."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- numpy over slices of a text column -------------------------------------


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def stretches(buf: np.ndarray, cut: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a long text's stretches of about ``limit`` bytes, which end after one of the bytes that ``cut`` marks.

    Where no such byte follows, the last stretch is longer: no word or piece is torn.
    """
    lo, n = 0, len(buf)
    while n - lo > limit:
        hi, step = lo + limit, 1 << 16
        while hi < n:
            found = np.flatnonzero(cut[buf[hi : hi + step]])
            if len(found):
                hi += int(found[0]) + 1
                break
            hi += step
        hi = min(hi, n)
        yield lo, hi
        lo = hi
    if lo < n or not n:
        yield lo, n


def vocabulary(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word in the list, the distinct words) for words at the given places of a slice."""
    if not len(s):
        return np.zeros(0, np.int64), []
    size = e - s
    ends = np.r_[0, np.cumsum(size)]
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1] - s, size)
    packed = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[inside])])
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _S33)
    x = x * _K2
    x = x ^ (x >> _S33)
    x = x * _K3
    return x ^ (x >> _S33)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        out = np.multiply.accumulate(out)
    return out


def words(buf: np.ndarray, offs: np.ndarray, letter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document with the total at the end) of words in a slice.

    letter: which of the 256 bytes words consist of, if not of all but space and U+0009 to U+000D.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = letter[buf] if letter is not None else ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    total = int(size.sum())
    first = np.cumsum(size) - size
    inside = np.arange(total, dtype=np.int64) - np.repeat(first, size)
    letters = buf[np.repeat(s, size) + inside].astype(np.uint64) + np.uint64(1)
    pw = powers(int(size.max()))
    return mix64(np.add.reduceat(letters * pw[inside], first) + size.astype(np.uint64) * _K1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g = mix64(g * _K1 + h[k : k + m])
    return g


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per document of a slice: its sorted distinct n-word shingles as 64-bit hashes.

    A document with fewer words has its whole sequence as one shingle; one
    without words has none. Letters A-Z are lower-cased.
    """
    low = lower_ascii(buf)
    s, e, first = words(low, offs)
    h = word_hashes(low, s, e)
    g = ngrams(h, n)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield mix64(ngrams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
