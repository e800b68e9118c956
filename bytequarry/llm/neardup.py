"""Near-duplicate documents by HyperMinHash: sketch, band, estimate, verify, connect.

A document is the set of its distinct n-word shingles. One 64-bit hash of a
shingle gives a bucket (top bits) and a value; a bucket keeps its smallest value
as a count of leading zeros and ten mantissa bits (Yu and Weber, HyperMinHash).
Documents that agree in a band of registers are candidates; the share of equal
registers, less the share expected by chance, estimates their Jaccard
similarity; candidates that pass are confirmed on their full sets.

Only connectivity is needed, so pairs within a bucket are never listed. First
each band's members are compared with the band's smallest member. What stays in
different components within a band is compared inside tasks, in blocks, and only
links leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, shingle_sets, slices, written
from .graph import components

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
ROWS = 4  # registers in a band: two texts of similarity 0.8 share no band with probability (1 - 0.8**4) ** 32 = 5e-8
BANDS = REGISTERS // ROWS
MANTISSA = 10
MARGIN = 0.22  # 6.2 standard deviations of the estimate at 0.8 over 128 registers: it loses such a pair with probability 3e-9
BLOCK = 1024  # members of a band that a task compares with as many
SALT_ROWS = 256  # members that are verified with one copy of their hub's text


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16, 0: empty) of sorted distinct 64-bit hashes."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        value = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(12)  # 52 bits: exact as a double
        part, exponent = np.frexp(value.astype(np.float64))
        zeros = np.where(value == 0, 52, 52 - exponent)
        mantissa = np.where(value == 0, 0, ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64))
        out[bucket[first]] = (zeros << MANTISSA) + mantissa + 1
    return out


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets of these sizes is equal.

    With a and b elements in a bucket the minima are close to exponential; they
    collide within a cell of width 2**-(z + 1 + MANTISSA) in the octave of z zeros.
    """
    a, b = np.asarray(na, float) / REGISTERS, np.asarray(nb, float) / REGISTERS
    rate, z = a + b, np.arange(53).reshape(-1, *[1] * np.ndim(a))
    octave = np.exp(-rate * 2.0 ** -(z + 1)) - np.exp(-rate * 2.0**-z)
    return np.clip((a * b / np.maximum(rate, 1e-9)) * (octave * 2.0 ** -(z + 1 + MANTISSA)).sum(0), 0, 0.5)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of registers (last axis) of sets of sizes na and nb."""
    some = ((ra > 0) | (rb > 0)).sum(-1)
    same = ((ra == rb) & (ra > 0)).sum(-1)
    by_chance = chance(na, nb)
    return np.clip((same / np.maximum(some, 1) - by_chance) / (1 - by_chance), 0, 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(n: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                size, digest, regs = [], [], []
                for s in shingle_sets(buf, offs, n):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append(registers(s).tobytes())
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "tkey", "n_shingles", "digest", "regs"])

    return run


def _bands(batches):
    """(band key, node, size) of non-empty bands."""
    number = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            keys = np.ascontiguousarray(regs).view(np.uint64)[:, :, 0]
            row, band = np.nonzero(keys)
            key = _mix(keys[row, band] ^ _mix(number + np.uint64(1))[0, band]).view(np.int64)
            nid, size = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield pa.record_batch([pa.array(key), pa.array(nid[row]), pa.array(size[row])], names=["band", "nid", "n"])


def _mix(x):
    from .common import mix64

    return mix64(x)


def _likely(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
                keep = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (estimate(ra, rb, na, nb) >= percent / 100 - MARGIN)
                yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(batch: pa.RecordBatch, n: int):
    for _, _, buf, offs in slices(batch.column("text")):
        yield from shingle_sets(buf, offs, n)


def _verify_star(n: int, percent: int):
    """Rows come by (hub, salt, kind): the hub's text, then its members'."""

    def run(batches):
        at, hub = None, None
        for batch in batches:
            a, b = [], []
            for h, salt, kind, nid, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "kind", "nid")), _sets(batch, n), strict=True):
                if kind == 0:
                    at, hub = (h, salt), s
                elif at == (h, salt) and similar(hub, s, percent):
                    a.append(h)
                    b.append(nid)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks_of(batches, columns):
    """Runs of rows with equal (band, x, y), across batches, as lists."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


def _cross(rows, x, y, percent):
    """Index pairs of a block that may be linked: other component, near sizes, likely, first shared band here.

    Yields (i, array of j). rows: (side block, component, nid, n, regs, band number, ...).
    """
    side, comp, nid, size = (np.array([r[k] for r in rows]) for k in range(4))
    regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, REGISTERS)
    bands = np.ascontiguousarray(regs).view(np.uint64)
    band = rows[0][5]
    order = np.arange(len(rows))
    for i in np.flatnonzero(side == x):
        near = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (nid != nid[i])
        near &= (order > i) if x == y else (side == y)
        j = np.flatnonzero(near)
        if len(j) and band:
            earlier = (bands[j, :band] == bands[i, :band]) & (bands[i, :band] != 0)
            j = j[~earlier.any(1)]
        if len(j):
            j = j[estimate(regs[j], regs[i][None, :], size[j], np.full(len(j), size[i])) >= percent / 100 - MARGIN]
        if len(j):
            yield int(i), j


_BLOCK_COLUMNS = ["band", "x", "y", "side", "comp", "nid", "n", "regs", "band_no"]


def _active(percent: int):
    """Members of a block that have a likely partner in another component."""

    def run(batches):
        for (band, x, y), rows in _blocks_of(batches, _BLOCK_COLUMNS):
            live = set()
            for i, j in _cross(rows, x, y, percent):
                live.add(i)
                live.update(j.tolist())
            if live:
                r = [rows[i] for i in sorted(live)]
                yield pa.record_batch([pa.array([v] * len(r), pa.int64()) for v in (band, x, y)] + [pa.array([q[k] for q in r], pa.int64() if k != 4 else pa.binary()) for k in range(6)], names=_BLOCK_COLUMNS)

    return run


def _verify_block(n: int, percent: int):
    """Links that join components of a block, found on full sets; pairs already joined are skipped."""

    def run(batches):
        for (_, x, y), rows in _blocks_of(batches, [*_BLOCK_COLUMNS, "text"]):
            rows = list({r[2]: r for r in rows}.values())
            texts = pa.array([r[6] for r in rows], pa.large_string())
            sets = [s for _, _, buf, offs in slices(texts) for s in shingle_sets(buf, offs, n)]
            root = {r[1]: r[1] for r in rows}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            a, b = [], []
            for i, js in _cross(rows, x, y, percent):
                for j in js.tolist():
                    p, q = find(rows[i][1]), find(rows[j][1])
                    if p != q and similar(sets[i], sets[j], percent):
                        root[p] = q
                        a.append(rows[i][2])
                        b.append(rows[j][2])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, component) per row of ``docs``: groups of near-duplicate texts.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets
    of n-word shingles (A-Z lower-cased, words are runs of non-spaces);
    component_id is the smallest id that links reach, component a number of the
    group's own (null without shingles), which differs where rows with the same
    id are in different groups. tkey is the MD5 of the text, so (doc_id, tkey)
    finds the row again.

    Null or blank texts have no shingles and are linked with nothing. Rows with
    equal sets form one class and are compared once, whatever their ids; repeated
    rows and ids are kept. A null id never becomes a component's id unless the
    component has no other. Columns other than the two are not read.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.unhex(F.md5("text")).alias("tkey"), "text")
    signed = written(keyed.mapInArrow(_sign(n), "doc_id long, tkey binary, n_shingles long, digest binary, regs binary"), "signatures")
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("digest").agg(F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.min(F.struct("doc_id", "tkey")).alias("at"))
    classes = written(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")

    bands = written(classes.select("nid", "n", "regs").mapInArrow(_bands, "band long, nid long, n long"), "bands")
    hubs = bands.groupBy("band").agg(F.count("*").alias("k"), F.min("nid").alias("hub")).where("k > 1")
    shared = written(bands.join(hubs, "band"), "shared")

    def with_texts(rows: DataFrame, node: str) -> DataFrame:
        """Rows with the text of a node; the documents move only if there are too many nodes to send them around."""
        want = written(rows.select(F.col(node).alias("nid")).distinct().join(classes.select("nid", "at"), "nid").select("nid", F.col("at.doc_id").alias("wid"), F.col("at.tkey").alias("wkey")), "wanted")
        small = fits_broadcast(want, 64)
        texts = keyed.join(F.broadcast(want) if small else want, F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("tkey") == F.col("wkey"))).select(F.col("nid").alias(node), "text")
        texts = written(texts, "texts").dropDuplicates([node]) if docs_repeat else written(texts, "texts")
        return rows.join(texts, node)

    docs_repeat = bool(signed.groupBy("doc_id", "tkey").count().where("count > 1").limit(1).count())

    # Each member of a band with the band's smallest member.
    reg = classes.select("nid", "n", "regs")
    pairs = shared.where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    pairs = pairs.join(reg.toDF("a", "na", "ra"), "a").join(reg.toDF("b", "nb", "rb"), "b")
    pairs = written(pairs.mapInArrow(_likely(percent), "a long, b long"), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("salts"))
    salted = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.col("b").alias("nid"))
    rows = salted.select("hub", "salt", F.lit(1).alias("kind"), "nid").union(salted.select("hub", "salt", F.lit(0), "hub").distinct())
    rows = with_texts(rows, "nid").select("hub", "salt", "kind", "nid", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    star = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind").mapInArrow(_verify_star(n, percent), "a long, b long")
    star = written(star, "links")
    roots = written(components(star), "roots")

    # Bands whose members are still in different components, in blocks.
    member = shared.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid"))
    mixed = member.groupBy("band", "hub", "k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.where("k > 2 and lo <> hi").join(roots.withColumnRenamed("node", "hub"), "hub", "left").select("band", F.coalesce("root", "hub").alias("main"))
    member = written(member.join(mixed, "band").withColumn("other", F.col("comp") != F.col("main")), "mixed")
    count = member.groupBy("band").agg(*(F.ceil(F.count_if(c) / BLOCK).alias(a) for c, a in ((~F.col("other"), "mains"), (F.col("other"), "others"))))
    member = member.join(count, "band").withColumn("side", F.when(F.col("other"), F.pmod(F.xxhash64("nid"), "others")).otherwise(-1 - F.pmod(F.xxhash64("nid"), "mains")))
    mains = F.transform(F.sequence(F.lit(1).cast("long"), F.col("mains")), lambda m: F.struct(F.col("side").alias("x"), (-m).alias("y")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda o: F.struct(F.least("side", o).alias("x"), F.greatest("side", o).alias("y")))
    as_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda o: F.struct(o.alias("x"), F.col("side").alias("y")))
    blocks = member.select("band", "side", "comp", "nid", F.explode(F.when(F.col("other"), F.concat(F.when(F.col("mains") > 0, mains).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>")), others)).otherwise(as_main)).alias("xy"))
    blocks = blocks.join(reg, "nid").select("band", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"), "side", "comp", "nid", "n", "regs")
    blocks = blocks.mapInArrow(_number_bands, "band long, x long, y long, side long, comp long, nid long, n long, regs binary, band_no long")
    schema = blocks.schema
    by_block = lambda df: df.repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "nid")
    live = written(by_block(blocks).mapInArrow(_active(percent), schema), "active")
    more = by_block(with_texts(live, "nid").select(*_BLOCK_COLUMNS, "text")).mapInArrow(_verify_block(n, percent), "a long, b long")
    links = written(star.union(more), "links")
    roots = components(links)

    label = some.join(classes.select("digest", "nid"), "digest").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid"))
    label = written(label.select("doc_id", "tkey", "n_shingles", "comp"), "labelled")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    grouped = label.join(least, "comp").select("doc_id", "tkey", "n_shingles", "component_id", F.col("comp").alias("component"))
    alone = signed.where("n_shingles = 0").select("doc_id", "tkey", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long"))
    return grouped.union(alone)


def _number_bands(batches):
    """Add which band of the registers a band key belongs to."""
    salt = _mix(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    for batch in batches:
        if not batch.num_rows:
            continue
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint64).reshape(-1, BANDS)
            key = part.column("band").to_numpy().view(np.uint64)
            number = (_mix(regs ^ salt[None, :]) == key[:, None]).argmax(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number, pa.int64())], names=[*part.schema.names, "band_no"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` less all but the first row (smallest id, then text key) of each near-duplicate group.

    All columns stay. Blank texts stay. Of rows that repeat the kept id and text
    one stays. A null id counts as larger than every other.
    """
    found = written(near_duplicates(docs, id_col, text_col, n, percent), "found")
    some = found.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    best = some.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    flags = some.join(best, "component")
    good = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    flags = written(flags.groupBy(F.col("doc_id").alias("_bq_id"), F.col("tkey").alias("_bq_key")).agg(F.max(good).alias("stays"), F.count("*").alias("n_rows")), "flags")
    lost, twice = flags.where("not stays"), flags.where("stays and n_rows > 1")
    keys = F.col(id_col).cast("long").eqNullSafe(F.col("_bq_id")) & (F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))) == F.col("_bq_key"))
    side = lambda x: F.broadcast(x) if fits_broadcast(x, 64) else x
    rest = docs.join(side(lost), keys, "left_anti")
    if not twice.limit(1).count():
        return rest
    same = rest.join(twice, keys, "left_semi").dropDuplicates([id_col, text_col])
    return rest.join(side(twice), keys, "left_anti").unionByName(same)
