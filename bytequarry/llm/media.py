"""ISO media containers: write payloads as sampled tracks, walk boxes, and index tracks without decoding.

The index holds, for each track, its codec, duration and the byte ranges of its
keyframes; it comes from the sample tables and the runs of movie fragments alone,
so payload bytes are never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy, written

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
UNIT = 64  # bytes of a sample that the writer makes
PER_CHUNK = 64  # samples of a chunk; each chunk's first sample is a keyframe
TIMESCALE = 8000
LONGEST = (1 << 63) - 1
#: Flags of a run's samples, of a fragment's header and of a run, as the format numbers them.
NOT_SYNC, BASE_GIVEN, ENTRY_GIVEN, DEFAULTS_GIVEN, BASE_IS_MOOF = 0x10000, 0x1, 0x2, (0x8, 0x10, 0x20), 0x20000
PLACE_GIVEN, FIRST_GIVEN, EACH_GIVEN = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)


# --- writing ----------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def _table(values: np.ndarray, kind: str) -> bytes:
    return struct.pack(">I", len(values)) + values.astype(kind).tobytes()


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, unit: int = UNIT, per_chunk: int = PER_CHUNK, timescale: int = TIMESCALE) -> bytes:
    """A container with one track of unsigned 8-bit mono samples, ``unit`` bytes a sample, that holds the payload."""
    if len(payload) % unit or not payload:
        raise ValueError(f"payload: a positive multiple of {unit} bytes")
    n = len(payload) // unit
    starts = np.arange(0, n, per_chunk)
    whole, rest = divmod(n, per_chunk)
    runs = [(1, per_chunk)] * bool(whole) + [(whole + 1, rest)] * bool(rest)
    duration = n * unit
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHII", 1, 8, 0, timescale << 16))

    def head(base: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, unit)),
            full(b"stss", 0, _table(starts + 1, ">u4")),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", first, count, 1) for first, count in runs)),
            full(b"stsz", 0, struct.pack(">II", unit, n)),
            full(b"co64", 0, _table(base + starts * unit, ">u8")),
        )
        minf = box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))), stbl)
        mdhd = full(b"mdhd", 1, struct.pack(">QQIQHH", 0, 0, timescale, duration, 0x55C4, 0))
        hdlr = full(b"hdlr", 0, bytes(4), b"soun", bytes(13))
        tkhd = full(b"tkhd", 1, struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = full(b"mvhd", 1, struct.pack(">QQIQ", 0, 0, timescale, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    big = 8 if len(payload) + 8 >= 1 << 32 else 0
    return head(len(head(0)) + 8 + big) + box(b"mdat", payload)


# --- reading ----------------------------------------------------------------


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of the boxes between two places; a box that reaches beyond its parent is an error."""
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("box size")
        yield kind, body, start + size
        start += size


def _clock(data, at):
    """(timescale, duration) of an mvhd or mdhd body; a duration of ones only is unknown, and 0 here."""
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    if duration == (1 << (64 if data[at] == 1 else 32)) - 1:
        return scale, 0
    if duration > LONGEST:
        raise ValueError("duration")
    return scale, duration


def _array(data, at, end, kind, width=1, skip=4):
    (n,) = struct.unpack_from(">I", data, at + skip)
    size = np.dtype(kind).itemsize * width * n
    if at + skip + 4 + size > end:
        raise ValueError("truncated table")
    return np.frombuffer(data, kind, n * width, at + skip + 4).astype(np.int64).reshape(-1, width)


def _sizes(data, at, end) -> np.ndarray:
    """Sizes of an stsz body; equal ones are listed only if the file can hold so many samples."""
    size, n = struct.unpack_from(">II", data, at + 4)
    if not size:
        return _array(data, at, end, ">u4", 1, 8)[:, 0]
    if size * n > len(data):
        raise ValueError("samples beyond the file")
    return np.full(n, size, np.int64)


def _small_sizes(data, at, end) -> np.ndarray:
    """Sizes of an stz2 body, of 4, 8 or 16 bits."""
    bits, (n,) = data[at + 7], struct.unpack_from(">I", data, at + 8)
    count = (n * bits + 7) // 8
    if bits not in (4, 8, 16) or at + 12 + count > end:
        raise ValueError("truncated table")
    raw = np.frombuffer(data, np.uint8, count, at + 12)
    return (np.stack([raw >> 4, raw & 15], 1).ravel()[:n] if bits == 4 else raw if bits == 8 else raw.view(">u2")).astype(np.int64)


def _track(data, start, end) -> dict:
    """Tables of one track: its boxes are walked with a list of what is still to be walked, however deep they nest."""
    t: dict = {"codec": None, "handler": None, "timescale": 0, "duration": 0, "number": None, "runs_of_fragments": []}
    waiting = [(start, end)]
    while waiting:
        for kind, at, stop in boxes(data, *waiting.pop()):
            if kind in CONTAINERS:
                waiting.append((at, stop))
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = _clock(data, at)
            elif kind == b"tkhd":
                (t["number"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
            elif kind == b"hdlr":
                t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
                t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stts":
                t["times"] = _array(data, at, stop, ">u4", 2)
            elif kind == b"stss":
                t["sync"] = _array(data, at, stop, ">u4")[:, 0] - 1
            elif kind == b"stsc":
                t["runs"] = _array(data, at, stop, ">u4", 3)
            elif kind == b"stsz":
                t["sizes"] = _sizes(data, at, stop)
            elif kind == b"stz2":
                t["sizes"] = _small_sizes(data, at, stop)
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _array(data, at, stop, ">u4" if kind == b"stco" else ">u8")[:, 0]
    return t


def _listed(track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, size, time) of each sample of the track's tables; as many rows as there are sizes, whatever other tables say."""
    sizes, chunks, runs, times = (track.get(k, np.zeros(s, np.int64)) for k, s in (("sizes", 0), ("chunks", 0), ("runs", (0, 3)), ("times", (0, 2))))
    n = len(sizes)
    if not n or not len(chunks) or not len(runs):
        return (np.zeros(0, np.int64),) * 3
    lasting = np.diff(np.r_[runs[:, 0] - 1, len(chunks)])
    if runs[0, 0] != 1 or (lasting < 0).any():
        raise ValueError("sample tables disagree")
    until = np.cumsum(np.repeat(runs[:, 1], lasting))  # samples up to each chunk's end
    if until[-1] < n:
        raise ValueError("sample tables disagree")
    number = np.arange(n)
    chunk = np.searchsorted(until, number, "right")
    before = np.cumsum(sizes) - sizes
    first = np.r_[0, until[:-1]]
    offset = chunks[chunk] + before - before[first[chunk]]
    step = np.searchsorted(np.cumsum(times[:, 0]), number, "right")
    steps = np.r_[times[:, 1], 0][np.minimum(step, len(times))]
    return offset, sizes, np.cumsum(steps) - steps


def _run(data, at, end, track, place, base, defaults, room) -> int:
    """Add the samples of a trun body to its track; where the next run's data starts unless it says so itself."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    if n > room:
        raise ValueError("samples beyond the file")
    if flags & PLACE_GIVEN:
        place = base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & FIRST_GIVEN:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    given = [f for f in EACH_GIVEN if flags & f]
    if at + 4 * len(given) * n > end:
        raise ValueError("truncated table")
    each = dict(zip(given, np.frombuffer(data, ">u4", n * len(given), at).astype(np.int64).reshape(n, len(given)).T, strict=True))
    steps, sizes, marks = (each[f] if f in each else np.full(n, d, np.int64) for f, d in zip(EACH_GIVEN, defaults, strict=False))
    sync = marks & NOT_SYNC == 0
    if first is not None and n:
        sync[0] = not first & NOT_SYNC
    length, lasting = int(sizes.sum()), int(steps.sum())
    if place < 0 or place + length > len(data):
        raise ValueError("samples beyond the file")
    if track["clock"] + lasting > LONGEST:
        raise ValueError("duration")
    track["runs_of_fragments"].append((place + np.cumsum(sizes) - sizes, sizes, track["clock"] + np.cumsum(steps) - steps, sync))
    track["clock"] += lasting
    track["duration"] = max(track["duration"], track["clock"])
    return place + length


def _fragment(data, moof, start, stop, known, defaults, room) -> int:
    """Add the samples of a moof, which starts at the place ``moof``, to their tracks; how many samples the file can still hold."""
    follows = moof
    for kind, at, end in boxes(data, start, stop):
        if kind != b"traf":
            continue
        track = None
        for inner, a, e in boxes(data, at, end):
            if inner == b"tfhd":
                flags, number = struct.unpack_from(">II", data, a)
                track, said = known.get(number), list(defaults.get(number, (0, 0, 0)))
                if track is None:
                    raise ValueError("fragment of no track")
                a += 8
                base = moof if flags & BASE_IS_MOOF else follows
                if flags & BASE_GIVEN:
                    (base,) = struct.unpack_from(">Q", data, a)
                    a += 8
                a += 4 * bool(flags & ENTRY_GIVEN)
                for k, flag in enumerate(DEFAULTS_GIVEN):
                    if flags & flag:
                        (said[k],) = struct.unpack_from(">I", data, a)
                        a += 4
                follows = base
            elif inner in (b"tfdt", b"trun") and track is None:
                raise ValueError("fragment of no track")
            elif inner == b"tfdt":
                (track["clock"],) = struct.unpack_from(">Q" if data[a] == 1 else ">I", data, a + 4)
            elif inner == b"trun":
                follows = _run(data, a, e, track, follows, base, said, room)
                room -= len(track["runs_of_fragments"][-1][0])
    return room


def samples(track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, size, time) of each sample: those of the track's tables, then those of fragments in the file's order."""
    return tuple(np.concatenate(c) for c in zip(_listed(track), *(r[:3] for r in track["runs_of_fragments"]), strict=True))


def keyframes(track: dict) -> np.ndarray:
    """Numbers of the track's samples from 0 that are keyframes: those that its table lists (all, if there is none), and the runs' own."""
    n = len(_listed(track)[0])
    listed = track["sync"][(track["sync"] >= 0) & (track["sync"] < n)] if "sync" in track else np.arange(n)
    return np.r_[listed, n + np.flatnonzero(np.concatenate([np.zeros(0, bool), *(r[3] for r in track["runs_of_fragments"])]))]


def tracks(media: bytes) -> list[dict]:
    """Tables of every track of a container, and the runs of its movie fragments.

    Without a time of its own a fragment goes on where its track has ended. All
    fragments together list at most one sample a byte of the file.
    """
    data = memoryview(media)
    out, defaults, moofs, before = [], {}, [], 0
    for kind, at, stop in boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, a, b in boxes(data, at, stop):
                if inner == b"trak":
                    out.append(_track(data, a, b))
                elif inner == b"mvex":
                    for k, c, _ in boxes(data, a, b):
                        if k == b"trex":
                            number, _, *said = struct.unpack_from(">5I", data, c + 4)
                            defaults[number] = said
        elif kind == b"moof":
            moofs.append((before, at, stop))
        before = stop
    known, room = {t["number"]: t for t in out if t["number"] is not None}, len(data)
    if moofs:
        for t in out:
            t["clock"] = sum(int(n) * int(step) for n, step in t.get("times", ()))
    for start, at, stop in moofs:
        room = _fragment(data, start, at, stop, known, defaults, room)
    return out


def describe(media: bytes | None) -> tuple[list[dict], str | None]:
    """Track index of one container and None, or no tracks and what is wrong with it."""
    out = []
    try:
        for t in tracks(media or b""):
            offset, size, time = samples(t)
            if len(size) and (offset.min() < 0 or (offset + size).max() > len(media)):
                raise ValueError("samples beyond the file")
            key = keyframes(t)
            ranges = [{"offset": int(o), "length": int(s), "time": int(x)} for o, s, x in zip(offset[key], size[key], time[key], strict=True)]
            out.append({"codec": t["codec"], "handler": t["handler"], "timescale": int(t["timescale"]), "duration": int(t["duration"]), "samples": len(size), "keyframes": ranges})
    except (ValueError, struct.error, IndexError) as e:
        return [], str(e) or type(e).__name__
    return out, None if media else "empty"


_KEY = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time", pa.int64())])
_TRACK = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(_KEY))])
TRACKS = "array<struct<codec:string,handler:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint,time:bigint>>>>"


def index(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All rows and columns with ``media_tracks`` and ``media_error``: every container's track index.

    Null and empty media, truncated boxes, tables that disagree and samples
    beyond the file give no tracks and an error's text; no row is dropped, and
    what is allocated stays within a small multiple of the file's size. Samples of
    movie fragments follow those of the sample tables, and a track lasts as long
    as they do; fragments of unknown tracks are an error. Repeated rows each have
    theirs; an empty table gives no rows. Columns with these two names are replaced.
    """

    @F.arrow_udf(f"struct<tracks:{TRACKS},error:string>")
    def described(media: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.record_batch([media], names=["media"]), "media"):
            found = [describe(m) for m in part.column(0).to_pylist()]
            out.append(pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.list_(_TRACK)), pa.array([e for _, e in found], pa.string())], names=["tracks", "error"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("tracks", pa.list_(_TRACK)), ("error", pa.string())]))

    names = [c for c in df.columns if c not in ("media_tracks", "media_error")]
    return df.select(*names, described(F.col(media_col).cast("binary")).alias("_bq_index")).select(*names, F.col("_bq_index.tracks").alias("media_tracks"), F.col("_bq_index.error").alias("media_error"))


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """The text's UTF-8 with bytes 0 up to a positive multiple of ``unit``, and its own length."""
    data = (text or "").encode()
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data)), len(data)


def _store(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            made = [padded(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])
    tidy()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 in a container; null texts are empty and have one unit of zeros.

    Repeated rows are stored each; an empty table gives no rows; other columns aren't read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def payload(media: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order, gathered by runs that lie together."""
    offset, size, _ = samples(track)
    if not len(size):
        return b""
    cuts = np.flatnonzero(offset[1:] != offset[:-1] + size[:-1]) + 1
    starts, ends = offset[np.r_[0, cuts]], (offset + size)[np.r_[cuts - 1, len(size) - 1]]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _feature(track: dict) -> str:
    """Codec, duration and keyframes of an indexed track as one line."""
    keys = np.array([(k["offset"], k["length"], k["time"]) for k in track["keyframes"]], "<i8")
    return f"codec={track['codec']};handler={track['handler']};seconds={track['duration'] / track['timescale']:.3f};samples={track['samples']};keyframes={len(keys)};ranges_crc32={zlib.crc32(keys.tobytes())}"


def _read_back(batches):
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for part in pieces(batch, "media"):
            out = []
            for doc, n, media, indexed, error in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_tracks", "media_error")), strict=True):
                if error:
                    raise ValueError(f"stored media of {doc}: {error}")
                back = payload(media, tracks(media)[0])
                out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), _feature(indexed[0])))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    tidy()


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as media, in a table of its own, index what was stored, and read its payload back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature (the index as a line). Nulls, repeats,
    empty tables and other columns are as in ``store_texts``.
    """
    stored = written(store_texts(docs), "media")
    return index(stored).mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
