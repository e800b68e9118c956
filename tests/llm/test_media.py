import hashlib
import random
import struct
import zlib

import pytest

from bytequarry.llm import media
from tests.llm.helpers import SCHEMA, awkward, docs


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 500])
def test_round_trip_and_keyframes(n):
    payload = random.Random(n).randbytes(64 * n)
    data = media.mux(payload)
    (track,) = media.tracks(data)
    assert media.payload(data, track) == payload
    (d,), error = media.describe(data)
    assert error is None
    assert (d["codec"], d["handler"], d["timescale"], d["duration"], d["samples"]) == ("raw ", "soun", 8000, 64 * n, n)
    assert [k["time"] for k in d["keyframes"]] == list(range(0, 64 * n, 4096))
    assert all(data[k["offset"] : k["offset"] + k["length"]] == payload[k["time"] : k["time"] + 64] for k in d["keyframes"])


def test_other_table_forms():
    """32-bit chunk places, a size for each sample, two runs of times, no list of keyframes, a box to the file's end, a large box."""
    sizes, body = [3, 5, 2, 7], bytes(range(17))
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    stbl = [
        media.full(b"stsd", 0, u(1), media.box(b"avc1", bytes(78))),
        media.full(b"stts", 0, u(2, 1, 10, 3, 20)),
        media.full(b"stsc", 0, u(2, 1, 1, 1, 2, 3, 1)),
        media.full(b"stsz", 0, u(0, 4, *sizes)),
        media.full(b"stco", 0, u(2, 24, 30)),
    ]
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", 0, u(0, 0, 100, 70, 0)), media.full(b"hdlr", 0, bytes(4), b"vide", bytes(13)), media.box(b"minf", media.box(b"stbl", *stbl)))))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 8 + 3 + 3 + 14) + bytes(8) + body[:3] + bytes(3) + body[3:]
    data = mdat + u(0) + b"moov" + moov[8:]
    (d,), error = media.describe(data)
    assert error is None
    assert (d["codec"], d["handler"], d["duration"], d["samples"]) == ("avc1", "vide", 70, 4)
    assert [(k["offset"], k["length"], k["time"]) for k in d["keyframes"]] == [(24, 3, 0), (30, 5, 10), (35, 2, 30), (37, 7, 50)]
    assert media.payload(data, media.tracks(data)[0]) == body


def test_damage_is_an_error_and_not_a_crash(spark):
    good = media.mux(bytes(640))
    rng = random.Random(4)
    for _ in range(300):
        bad = bytearray(good[: rng.randint(1, len(good))])
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        media.describe(bytes(bad))
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, good[:-5], "x"), (5, b"no box at all", "x")]
    table = spark.createDataFrame([(i, bytearray(m) if m is not None else None, s) for i, m, s in rows], "doc_id long, media binary, media_error string")
    got = {r.doc_id: r for r in media.index(table).collect()}
    assert got[1].media_tracks[0].samples == 10
    assert got[1].media_error is None
    assert (got[2].media_error, got[3].media_error) == ("empty", "empty")
    assert got[4].media_error == "box size"
    assert got[5].media_error
    assert all(not got[k].media_tracks for k in (2, 3, 4, 5))


def track(*tables, deep=0):
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    boxes = b"".join(tables)
    for _ in range(deep):
        boxes = media.box(b"udta", boxes)
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, u(0, 0, 100, 70, 0)), media.box(b"minf", media.box(b"stbl", boxes)))
    return media.box(b"moov", media.box(b"trak", mdia))


def flagged(kind, flags, *parts):
    return media.box(kind, struct.pack(">I", flags), *parts)


def fragment(*boxes):
    return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, struct.pack(">I", 1)), *boxes))


def movie(trex=(1, 10, 0, 0x10000)):
    """A track of number 1 with no samples of its own, and what fragments leave open."""
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, u(0, 0, 100, 0, 0)), media.full(b"hdlr", 0, bytes(4), b"vide", bytes(13)), media.box(b"minf", media.box(b"stbl", media.full(b"stsd", 0, u(1), media.box(b"avc1", bytes(78))))))
    return media.box(b"moov", media.box(b"mvex", media.full(b"trex", 0, u(1, *trex))), media.box(b"trak", media.full(b"tkhd", 0, u(0, 0, 1, 0, 0)), mdia))


def test_movie_fragments():
    """Runs with sizes, times and flags of their own or by default; places from the fragment, from a base and from what precedes."""
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    head, body = movie(), bytes(range(60))

    def one(place):  # two runs: sizes and flags each, a first flag; the second goes on where the first ends
        a = flagged(b"trun", 0x1 | 0x200 | 0x400, u(3, place, 5, 0, 7, 0x10000, 2, 0))
        b = flagged(b"trun", 0x4 | 0x100 | 0x200 | 0x800, u(2, 0, 4, 3, 0, 6, 1, 0))
        return media.box(b"moof", media.full(b"mfhd", 0, u(1)), media.box(b"traf", flagged(b"tfhd", 0x20000, u(1)), media.full(b"tfdt", 1, u(0, 1000)), a, b))

    def two(base):  # given base, sizes and times by default, no time of its own, nothing is a keyframe but the first
        return media.box(b"moof", media.box(b"traf", flagged(b"tfhd", 0x1 | 0x2 | 0x8 | 0x10, u(1, 0, base, 1, 20, 8)), flagged(b"trun", 0x4, u(3, 0))))

    n = len(one(0))
    first = head + one(n + 8) + media.box(b"mdat", body[:18])
    data = first + two(len(first) + len(two(0)) + 8) + media.box(b"mdat", body[18:42])
    (d,), error = media.describe(data)
    assert error is None
    at = len(head) + n + 8
    late = len(data) - 24
    assert (d["codec"], d["samples"], d["timescale"], d["duration"]) == ("avc1", 8, 100, 1000 + 30 + 10 + 60)
    assert [(k["offset"], k["length"], k["time"]) for k in d["keyframes"]] == [(at, 5, 1000), (at + 12, 2, 1020), (at + 14, 3, 1030), (late, 8, 1040)]
    assert media.payload(data, media.tracks(data)[0]) == body[:42]
    rng = random.Random(9)
    for _ in range(2000):
        bad = bytearray(data[: rng.randint(1, len(data))] if rng.random() < 0.3 else data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        found, _ = media.describe(bytes(bad))
        assert sum(t["samples"] for t in found) <= 2 * len(data)


def test_hostile_tables_allocate_little(spark):
    """Counts that the file can't hold, boxes nested deep, places out of the file and fragments end in an error's text or in bounded rows."""
    u = lambda *v: struct.pack(f">{len(v)}I", *v)
    big = (1 << 32) - 1
    chunks, one = media.full(b"stco", 0, u(1, 8)), media.full(b"stsz", 0, u(0, 1, 4))
    run = media.full(b"stsc", 0, u(1, 1, 1, 1))
    cases = {
        "stsz": (track(media.full(b"stsz", 0, u(8, big)), chunks, run), "samples beyond the file"),
        "stsz0": (track(media.full(b"stsz", 0, u(0, big)), chunks, run), "truncated table"),
        "stz2": (track(media.full(b"stz2", 0, u(8, big)), chunks, run), "truncated table"),
        "stsc": (track(one, chunks, media.full(b"stsc", 0, u(1, 1, big, 1))), None),
        "stsc2": (track(one, chunks, media.full(b"stsc", 0, u(2, 1, 1, 1, big, 1, 1))), "sample tables disagree"),
        "stts": (track(one, chunks, run, media.full(b"stts", 0, u(2, big, 5, big, 5))), None),
        "stss": (track(one, chunks, run, media.full(b"stss", 0, u(2, 0, 1))), None),
        "co64": (track(one, media.full(b"co64", 0, u(1, big, big)), run), "samples beyond the file"),
        "stco": (track(one, media.full(b"stco", 0, u(1, big)), run), "samples beyond the file"),
        "deep": (track(one, chunks, run, deep=5000), None),
        "moof": (track(one, chunks, run) + media.box(b"moof"), None),
        "mvex": (media.box(b"moov", media.box(b"mvex")), None),
        "unknown": (track(one, chunks, run) + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, u(9)))), "fragment of no track"),
        "headless": (movie() + media.box(b"moof", media.box(b"traf", media.full(b"trun", 0, u(0)))), "fragment of no track"),
        "trun": (movie() + fragment(media.full(b"trun", 0, u(big))), "samples beyond the file"),
        "truns": (movie() + fragment(*[media.full(b"trun", 0, u(100))] * 50), "samples beyond the file"),
        "trun_cut": (movie() + fragment(flagged(b"trun", 0x200, u(3, 1))), "truncated table"),
        "tfdt": (movie() + fragment(media.full(b"tfdt", 1, u(big, big)), flagged(b"trun", 0x100, u(1, 5))), "duration"),
        "base": (movie() + media.box(b"moof", media.box(b"traf", flagged(b"tfhd", 1, u(1, big, big)), flagged(b"trun", 0, u(1)))), "samples beyond the file"),
        "mdhd": (media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", 1, u(0, 0, 0, 0, 1, big, 5, 0))))), "duration"),
        "unknown_mdhd": (media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", 1, u(0, 0, 0, 0, 1, big, big, 0))))), None),
    }
    table = spark.createDataFrame([(k, bytearray(m)) for k, (m, _) in cases.items()], "name string, media binary")
    got = {r.name: r for r in media.index(table).collect()}
    assert {k: r.media_error for k, r in got.items()} == {k: e for k, (_, e) in cases.items()}
    assert [k["offset"] for k in got["stss"].media_tracks[0].keyframes] == [8]
    assert [got[k].media_tracks[0].samples for k in ("stsc", "stts", "deep", "moof")] == [1] * 4


def test_texts_as_media(spark):
    rows = awkward()
    got = media.text_media(docs(spark, rows, clash=True)).collect()
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.padded(t)[0]).hexdigest(), zlib.crc32(media.padded(t)[0][-64:])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) for r in got)
    assert media.text_media(spark.createDataFrame([], SCHEMA)).count() == 0
