"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection of sorted arrays.

Sets of n-word shingles whose similarity is ``percent`` at least differ in few
shingles, and in size by little. Sizes are cut into bands such that only sets of
one band or of two neighbouring bands can be linked. Within a band hash space is
cut into one part more than linked sets can differ in shingles, so that at least
one part is equal in both: a tile holds the sets of a band, and those of the band
below that are large enough, that agree in one part. No link is lost.

Within a tile, hashed bitmaps bound from above how many shingles two sets share:
a bit that one has and the other lacks is a shingle that they don't share. What
passes is decided on full sets. Only connectivity is needed, so each set is first
compared with one other, of its tiles' smallest members; what stays in different
components within a tile is compared in blocks, inside tasks, and only links leave them.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, mix64, pieces, shingle_sets, slices, tidy, written
from .graph import components

_K = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a bitmap: a power of two, about twice the set's size, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Members and shingles of a tile's side that a task compares with as many.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SALT_ROWS = 256  # members that are verified with one copy of their hub's text


@cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest size, number of parts) of each band of sizes, as far as 2**40."""
    if not 0 < percent < 100:
        raise ValueError("percent: from 1 to 99")
    low, parts, lo = [], [], 1
    while lo < 1 << 40:
        hi = lo * 100 // percent
        low.append(lo)
        parts.append(2 * hi * (100 - percent) // (100 + percent) + 1)
        lo = hi + 1
    return np.array(low), np.array(parts)


def tiles_of(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(keys of the tiles that a set of sorted hashes belongs to, how many of them are of its own band).

    Sets so small that linked ones are equal belong to none.
    """
    low, parts = bands(percent)
    own = int(np.searchsorted(low, len(hashes), "right")) - 1
    total = np.r_[np.uint64(0), np.cumsum(mix64(hashes + _K))]
    out, count = [], 0
    for band in (own, own + 1):
        m = int(parts[band])
        if m == 1 or (band > own and 100 * len(hashes) < percent * int(low[band])):
            continue
        number = np.arange(m, dtype=np.uint64)
        at = np.r_[np.searchsorted(hashes, number * np.uint64((1 << 64) // m)), len(hashes)]
        held = total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _K
        out.append(mix64(held + mix64(number + np.uint64(band << 32))))
        count += m * (band == own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), count


def bitmap(hashes: np.ndarray) -> bytes:
    """The hashes' top bits as a bitmap of a power of two bits."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else LEAST_BITS
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, halved to ``size`` bytes by joining neighbouring bits."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = np.packbits(np.unpackbits(out, bitorder="little").reshape(-1, 2).max(1), bitorder="little")
    return out.view(np.uint64) if len(out) == len(bits) else np.ascontiguousarray(out).view(np.uint64)


def may_link(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bitmaps (a row each) allow the overlap that a link needs."""
    lacks = np.bitwise_count(one & ~others).sum(-1, dtype=np.int64)
    more = np.bitwise_count(others & ~one).sum(-1, dtype=np.int64)
    overlap = np.minimum(size - lacks, sizes - more)
    return (100 + percent) * overlap >= percent * (size + sizes)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, by looking up the smaller sorted array in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(n: int, percent: int):
    names = ["doc_id", "tkey", "n_shingles", "digest", "bits", "tiles", "own"]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                rows = []
                for s in shingle_sets(buf, offs, n):
                    tiles, own = tiles_of(s, percent) if len(s) else (s, 0)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bitmap(s), tiles.tobytes(), own))
                size, digest, bits, tiles, own = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.array(tiles, pa.binary()), pa.array(own, pa.int64())], names=names)

    return run


def _members(batches):
    """(tile, node) of rows (node, tiles)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            blobs = part.column(1).to_pylist()
            row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
            key = np.frombuffer(b"".join(blobs), np.int64)
            yield pa.record_batch([pa.array(key), part.column(0).take(pa.array(row))], names=["tile", "nid"])


def _likely(percent: int):
    """Pairs that bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, na, nb, bx, by in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb")), strict=True):
                size = min(len(bx), len(by))
                if may_link(folded(bx, size), na, folded(by, size), np.int64(nb), percent):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sets(texts: pa.Array, n: int):
    for _, _, buf, offs in slices(texts):
        yield from shingle_sets(buf, offs, n)


def _verify_star(n: int, percent: int):
    """Rows come by (hub, salt, kind): the hub's text, then its members'."""

    def run(batches):
        at, hub = None, None
        for part in (p for batch in batches for p in pieces(batch, "text")):
            a, b = [], []
            for h, salt, kind, nid, s in zip(*(part.column(c).to_pylist() for c in ("hub", "salt", "kind", "nid")), _sets(part.column("text"), n), strict=True):
                if kind == 0:
                    at, hub = (h, salt), s
                elif at == (h, salt) and linked(hub, s, percent):
                    a.append(h)
                    b.append(nid)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tidy()

    return run


_MEMBER = ["tile", "x", "y", "side", "comp", "nid", "n", "bits", "tiles"]
_MEMBER_SCHEMA = "tile long, x long, y long, side long, comp long, nid long, n long, bits binary, tiles binary"


def _own_tiles(batches):
    """Leave of a member's tiles those of the band that this row's tile belongs to, with its own place among them in front."""
    for batch in batches:
        tiles = []
        for key, blob, own in zip(*(batch.column(c).to_pylist() for c in ("tile", "tiles", "own")), strict=True):
            keys = np.frombuffer(blob, np.int64)
            at = int(np.flatnonzero(keys == key)[0])
            first, part = (0, keys[:own]) if at < own else (own, keys[own:])
            tiles.append(np.r_[np.int64(at - first), part].tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _MEMBER[:-1]), pa.array(tiles, pa.binary())], names=_MEMBER)


def _blocks(batches, n: int = 0):
    """Runs of rows with equal (tile, x, y), across batches, as lists; a node stands once. With n, texts become sets of n-word shingles."""
    key, rows = None, {}
    for part in (p for batch in batches for p in pieces(batch, "bits", "tiles", *["text"] * (n > 0))):
        columns = [part.column(c).to_pylist() for c in _MEMBER]
        for row in zip(*columns, *([_sets(part.column("text"), n)] if n else []), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, list(rows.values())
                key, rows = row[:3], {}
            rows[row[5]] = row[3:]
    if rows:
        yield key, list(rows.values())


def _cross(rows, x, y, percent):
    """(i, array of j) of a block's pairs in different components that may be linked and share no earlier tile.

    rows: (side, component, node, size, bitmap, tiles, ...).
    """
    side, comp, _, size = (np.array([r[k] for r in rows]) for k in range(4))
    width = min(len(r[4]) for r in rows)
    bits = np.stack([folded(r[4], width) for r in rows])
    tiles = np.stack([np.frombuffer(r[5], np.int64) for r in rows])
    place, order = int(tiles[0, 0]), np.arange(len(rows))
    for i in np.flatnonzero(side == x):
        j = np.flatnonzero((comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & ((order > i) if x == y else (side == y)))
        if len(j) and place:
            j = j[~(tiles[j, 1 : place + 1] == tiles[i, 1 : place + 1]).any(1)]
        if len(j):
            j = j[may_link(bits[i], int(size[i]), bits[j], size[j], percent)]
        if len(j):
            yield int(i), j


def _active(percent: int):
    """Members of a block that have a likely partner in another component."""

    def run(batches):
        for key, rows in _blocks(batches):
            live = set()
            for i, j in _cross(rows, key[1], key[2], percent):
                live.add(i)
                live.update(j.tolist())
            if live:
                picked = [(*key, *rows[i]) for i in sorted(live)]
                yield pa.record_batch([pa.array(c, pa.int64() if k < 7 else pa.binary()) for k, c in enumerate(zip(*picked, strict=True))], names=_MEMBER)

    return run


def _verify_block(n: int, percent: int):
    """Links that join components of a block, on full sets; pairs already joined are skipped."""

    def run(batches):
        for key, rows in _blocks(batches, n):
            root = {r[1]: r[1] for r in rows}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            a, b = [], []
            for i, js in _cross(rows, key[1], key[2], percent):
                for j in js.tolist():
                    p, q = find(rows[i][1]), find(rows[j][1])
                    if p != q and linked(rows[i][6], rows[j][6], percent):
                        root[p] = q
                        a.append(rows[i][2])
                        b.append(rows[j][2])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tidy()

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, component) per row of ``docs``: components of the similarity join.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets
    of n-word shingles (A-Z lower-cased; words are runs of other characters than
    space and U+0009 to U+000D; fewer words than n are one shingle). component_id
    is the smallest id that links reach, component a number of the component's
    own (null without shingles). tkey is the MD5 of the text, so that (doc_id,
    tkey) finds the row again.

    Null or blank texts have no shingles and are linked with nothing. Rows with
    equal sets are one class and compared once, whatever their ids; repeated rows
    and ids are kept. A null id is a component's only if it has no other. Empty
    tables give no rows. Columns other than the two are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.unhex(F.md5("text")).alias("tkey"), "text")
    signed = written(keyed.mapInArrow(_sign(n, percent), "doc_id long, tkey binary, n_shingles long, digest binary, bits binary, tiles binary, own long"), "signed")
    some = signed.where("n_shingles > 0")
    at = F.min(F.struct("doc_id", "tkey")).alias("at")
    classes = some.groupBy("digest").agg(*(F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("bits", "bits"), ("tiles", "tiles"), ("own", "own"))), at)
    classes = written(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")

    # Most tiles that are shared have two members, which their smallest and largest are; members move again only for larger tiles.
    members = classes.select("nid", "tiles").mapInArrow(_members, "tile long, nid long")
    hubs = written(members.groupBy("tile").agg(F.count("*").alias("k"), F.min("nid").alias("hub"), F.max("nid").alias("last")).where("k > 1"), "hubs")
    large = hubs.where("k > 2").select("tile", "hub")
    shared = hubs.where("k = 2").select("tile", F.explode(F.array("hub", "last")).alias("nid"), "hub")
    shared = written(shared.unionByName(members.join(F.broadcast(large) if fits_broadcast(large, 32) else large, "tile")), "shared")
    repeats = bool(signed.groupBy("doc_id", "tkey").count().where("count > 1").limit(1).count())

    def with_texts(rows: DataFrame) -> DataFrame:
        """Rows with their node's text; the documents move only if there are too many nodes to send them around."""
        want = written(rows.select("nid").distinct().join(classes.select("nid", "at"), "nid").select("nid", F.col("at.doc_id").alias("wid"), F.col("at.tkey").alias("wkey")), "wanted")
        side = F.broadcast(want) if fits_broadcast(want, 64) else want
        texts = written(keyed.join(side, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("tkey") == F.col("wkey"))).select("nid", "text"), "texts")
        return rows.join(texts.dropDuplicates(["nid"]) if repeats else texts, "nid")

    # Each set with one other: of its tiles' smallest members the one that it meets most often, which is most like it.
    size = classes.select("nid", "n", "bits")
    met = shared.where("nid <> hub").groupBy("nid", "hub").agg(F.count("*").alias("tiles"))
    pairs = met.groupBy(F.col("nid").alias("b")).agg((-F.max(F.struct("tiles", (-F.col("hub")).alias("less")))["less"]).alias("a"))
    pairs = pairs.join(size.toDF("a", "na", "xa"), "a").join(size.toDF("b", "nb", "xb"), "b")
    pairs = written(pairs.mapInArrow(_likely(percent), "a long, b long"), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("salts"))
    salted = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.col("b").alias("nid"))
    star = salted.select("hub", "salt", F.lit(1).alias("kind"), "nid").union(salted.select("hub", "salt", F.lit(0), "hub").distinct())
    star = with_texts(star).select("hub", "salt", "kind", "nid", "text").repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    star = written(star.mapInArrow(_verify_star(n, percent), "a long, b long"), "links")
    roots = written(components(star), "roots")

    # Tiles whose members are still in different components: the largest share's component against the others, and these in blocks.
    member = shared.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid"))
    mixed = member.groupBy("tile", "hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = mixed.join(roots.withColumnRenamed("node", "hub"), "hub", "left").select("tile", F.coalesce("root", "hub").alias("main"))
    member = member.join(mixed, "tile").join(classes.select("nid", "n"), "nid")
    member = written(member.select("tile", "nid", "n", "comp", (F.col("comp") != F.col("main")).alias("other")), "mixed")
    blocks_of = lambda c: F.ceil(F.greatest(F.count_if(c) / BLOCK, F.sum(F.when(c, F.col("n"))) / BLOCK_SHINGLES))
    count = member.groupBy("tile").agg(F.coalesce(blocks_of(~F.col("other")), F.lit(0)).alias("mains"), F.coalesce(blocks_of(F.col("other")), F.lit(0)).alias("others"))
    member = member.join(count, "tile").withColumn("side", F.when(F.col("other"), F.pmod(F.xxhash64("nid"), "others")).otherwise(-1 - F.pmod(F.xxhash64("nid"), "mains")))
    upto = lambda c, f: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), f)).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    with_mains = upto("mains", lambda m: F.struct(F.col("side").alias("x"), (-1 - m).alias("y")))
    with_others = upto("others", lambda o: F.struct(F.least("side", o).alias("x"), F.greatest("side", o).alias("y")))
    as_main = upto("others", lambda o: F.struct(o.alias("x"), F.col("side").alias("y")))
    blocks = member.select("tile", "side", "comp", "nid", F.explode(F.when(F.col("other"), F.concat(with_mains, with_others)).otherwise(as_main)).alias("xy"))
    blocks = blocks.join(classes.select("nid", "n", "bits", "tiles", "own"), "nid").select("tile", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"), "side", "comp", "nid", "n", "bits", "tiles", "own")
    by_block = lambda df: df.repartition(parts, "tile", "x", "y").sortWithinPartitions("tile", "x", "y", "nid")
    live = written(by_block(blocks.mapInArrow(_own_tiles, _MEMBER_SCHEMA)).mapInArrow(_active(percent), _MEMBER_SCHEMA), "active")
    more = by_block(with_texts(live).select(*_MEMBER, "text")).mapInArrow(_verify_block(n, percent), "a long, b long")
    roots = components(written(star.union(more), "links"))

    label = some.join(classes.select("digest", "nid"), "digest").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid"))
    label = written(label.select("doc_id", "tkey", "n_shingles", "comp"), "labelled")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    grouped = label.join(least, "comp").select("doc_id", "tkey", "n_shingles", "component_id", F.col("comp").alias("component"))
    alone = signed.where("n_shingles = 0").select("doc_id", "tkey", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long"))
    return grouped.union(alone)


#: ``jaccard_join`` with ids that don't repeat, in DuckDB's SQL.
JOIN_SQL = r"""with recursive texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
 sets as (select doc_id, case when len(ws) >= {n} then list_distinct(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from texts),
 rows as (select doc_id, len(s) as size, unnest(s) as g from sets),
 links as (select a.doc_id as a, b.doc_id as b from rows a join rows b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= {percent} * (any_value(a.size) + any_value(b.size) - count(*))),
 reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, len(s)::bigint as n_shingles, component_id from sets join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)"""
