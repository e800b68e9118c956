"""Importance resampling towards a target: word-id suffix arrays, bucket gains, noisy ranks.

A text's features are its runs of 1 to ``n`` consecutive words, hashed into
buckets. How much more often a bucket occurs in the target's texts than in the
corpus is its gain; a text's weight is the sum of its features' gains, and the
texts with the largest weight plus Gumbel noise are drawn without replacement
(Xie et al., Data Selection for Language Models via Importance Resampling).

A task numbers the distinct words of a stretch of texts and sorts its suffixes
of word numbers. Neighbours in that order that share d words are one run of
equal d-grams, so that each distinct d-gram is hashed once and its bucket goes
back to all of its occurrences.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, pieces, slices, stretches, vocabulary, words, written

#: Words are ASCII letters and digits and whatever is beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[97:123] = LETTER[128:] = True
#: Bytes of text in one suffix array.
SORT_BYTES = 8 << 20


def suffix_order(ids: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, as far as ``depth`` words tell.

    ids: word numbers from 1; end: one past the last place of each place's text.
    Ranks of twice as many words come from pairs of ranks; a text's end is less than every word.
    """
    rank, known, at = ids, 1, np.arange(len(ids))
    while known < depth:
        later = at + known
        inside = later < end
        next_ = np.zeros(len(ids), np.int64)
        next_[inside] = rank[later[inside]]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + next_, return_inverse=True)[1] + 1
        known *= 2
    return np.argsort(rank, kind="stable")


def common_words(ids: np.ndarray, end: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix in order shares with the one before it, ``depth`` at most; the first shares 0."""
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(depth):
        a, b = order[live], order[live - 1]
        live = live[(a + d < end[a]) & (b + d < end[b])]
        live = live[ids[order[live] + d] == ids[order[live - 1] + d]]
        common[live] = d + 1
    return common


def gram_hashes(ids: np.ndarray, end: np.ndarray, vocab: list[bytes], n: int) -> list[np.ndarray]:
    """For d = 1 to n: CRC-32 of the d-gram (joined by a space) that starts at each place, -1 where the text ends before."""
    order = suffix_order(ids, end, n)
    common = common_words(ids, end, order, n)
    out, shorter, glue = [], np.zeros(len(ids), np.int64), b""
    for d in range(1, n + 1):
        whole = order + d <= end[order]
        first = (common < d) & whole  # of each run of equal d-grams
        at = order[first]
        once = [zlib.crc32(glue + vocab[w - 1], c) for w, c in zip(ids[at + d - 1].tolist(), shorter[at].tolist(), strict=True)]
        found = np.full(len(ids), -1, np.int64)
        if len(at):
            found[order[whole]] = np.array(once, np.int64)[np.cumsum(first)[whole] - 1]
        out.append(found)
        shorter, glue = found, b" "
    return out


def _in_stretch(buf: np.ndarray, offs: np.ndarray, own: int, n: int):
    """(words, gram hashes) of each text of a slice; only words and grams that start before ``own`` count."""
    s, e, first = words(buf, offs, LETTER)
    ids, vocab = vocabulary(buf, s, e)
    end = np.repeat(first[1:], np.diff(first))
    grams = gram_hashes(ids + 1, end, vocab, n)
    mine = s < own
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        yield int(mine[a:b].sum()), [g[a:b][mine[a:b] & (g[a:b] >= 0)] for g in grams]


def _ahead(buf: np.ndarray, at: int, n: int) -> int:
    """Where n whole words after ``at`` have ended."""
    step = 64 * n
    while n and at + step < len(buf):
        _, e, _ = words(buf[at : at + step], np.array([0, step]), LETTER)
        if (e < step).sum() >= n:
            return at + step
        step *= 2
    return len(buf) if n else at


def features(buf: np.ndarray, offs: np.ndarray, n: int, limit: int = SORT_BYTES):
    """(words, CRC-32s of all runs of 1 to n words) of each text of a slice of bytes; long texts stretch by stretch."""
    low = lower_ascii(buf)
    if len(offs) != 2 or len(low) <= 2 * limit:
        for count, grams in _in_stretch(low, offs, len(low), n):
            yield count, np.concatenate(grams)
        return
    total, found = 0, []
    for a, b in stretches(low, ~LETTER, limit):
        to = _ahead(low, b, n - 1)
        for count, grams in _in_stretch(low[a:to], np.array([0, to - a]), b - a, n):
            total += count
            found += grams
    yield total, np.concatenate(found)


def _kind(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _features(n: int, buckets: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), SORT_BYTES):
                number, size, blobs = [], [], []
                for count, grams in features(buf, offs, n):
                    number.append(count)
                    size.append(len(grams))
                    blobs.append((grams % buckets).astype(_kind(buckets)).tobytes())
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(number, pa.int64()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return run


def _count(buckets: int):
    """One task's occurrences of each bucket it has met."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), _kind(buckets)), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return run


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, from the first 32 bits of a hash; a null id counts as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "buckets", limit=16 << 20):
                weight = [int(gain[np.frombuffer(b.as_buffer(), _kind(len(gain)))].sum()) for b in part.column("buckets")]
                score = [w + noise(d, seed) for w, d in zip(weight, part.column("doc_id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def _number(batches):
    """Add the partition and the place of each row within it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        here = pa.array(np.arange(at, at + batch.num_rows))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int64()), here], names=[*batch.schema.names, "part", "place"])


def rank_first(rows: DataFrame, order: list[Column], percent: int) -> DataFrame:
    """``rows`` with rank: 1, 2, 3.. in the given total order for the first ``percent`` of them, else null.

    Rows are dealt into ranges of the order; one number a range comes to the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = written(dealt.mapInArrow(_number, f"{kinds}, part long, place long"), "ranked")
    base, bases = 0, []
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        bases.append((part, base))
        base += n
    first = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + F.col("place") + 1
    return dealt.join(first, "part").withColumn("rank", F.when(rank <= percent * base // 100, rank)).drop("part", "place", "base")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; rank is null for rows that aren't drawn.

    Features are the runs of 1 to ``n`` consecutive words (A-Z lower-cased;
    letters and digits of ASCII and all beyond it), repeats counted. A bucket's gain is
    floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for s of S features
    in ``docs`` and t of T in ``target``, whose column has the same name. Of the N rows
    with at least ``least_words`` words floor(percent * N / 100) are drawn, by
    weight plus Gumbel noise of (seed, id), ties to the smaller id, null ids last.

    Null and empty texts have no features and weight 0; their score is the noise.
    Rows that repeat an id or text count each on their own, and get ranks of their own. An empty
    target has gains from the corpus alone; an empty corpus gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    keyed = lambda df, key: df.select(key.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(_features(n, buckets), "doc_id long, n_words long, n_features long, buckets binary")
    found = written(keyed(docs, F.col(id_col).cast("long")), "features")
    counts = lambda df, name: df.select("buckets").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))
    grid = spark.range(buckets).select(F.col("id").alias("bucket")).join(counts(found, "s"), "bucket", "left").join(counts(keyed(target, F.lit(None).cast("long")), "t"), "bucket", "left")
    rows = sorted(grid.na.fill(0).collect())  # one row a bucket
    all_s, all_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    gain = np.array([math.floor(1000 * math.log((float(r["t"] + 1) * (all_s + buckets)) / (float(r["s"] + 1) * (all_t + buckets)))) for r in rows], np.int64)

    scored = found.mapInArrow(_score(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    enough = F.col("n_words") >= least_words
    drawn = rank_first(scored.where(enough), order, percent)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: ``resample`` with runs of one word, in DuckDB's SQL; the table of CRC-32 comes from its polynomial.
RESAMPLE_SQL = r"""with crcs as (select list(list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by b) as tab from range(256) t(b)),
feats as (select 0 as side, rowid as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from (select row_number() over () as rowid, * from documents)
 union all select 1, null, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') from benchmark),
occ as (select side, row, doc_id, unnest(ws) as w from feats), counted as (select side, row, doc_id, w, count(*) as n from occ group by all),
vocab as (select distinct w from counted), coded as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::bigint, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from vocab, crcs),
counts as (select bucket, coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from counted join coded using (w) group by bucket),
sums as (select sum(s) as ss, sum(t) as tt from counts),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * (ss + 10000)::double) / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from counts, sums),
weights as (select row, sum(n * gain)::bigint as weight from counted join coded using (w) join gains using (bucket) where side = 0 group by row),
scored as (select doc_id, row, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
 coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from feats left join weights using (row) where side = 0)
select doc_id, n_features, weight, score, case when n_features >= 20 and row_number() over (partition by n_features >= 20 order by score desc, doc_id) <= (10 * (select count(*) from scored where n_features >= 20)) // 100
 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as rank from scored"""
