"""I-Match document fingerprints with randomised lexicons, in DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon. A text's
distinct lexicon terms are sorted and hashed once for the whole lexicon and once
for each of several random sub-lexicons (Kolcz, Chowdhury, Alspector); the
sub-lexicons keep from half of the terms to one in a thousand, so that some of
them hold few terms of any text, and survive where texts agree in part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below, fits_broadcast, ranges, text_or_empty, written

#: Band of ln(documents / documents with the term): terms of a tenth to a two-thousandth of all documents.
IDF_BAND = (math.log(10), math.log(2000))
#: Share of lexicon terms that each sub-lexicon keeps, as a power of one half; the first is the whole lexicon.
#: Most keep about one term of a usual text, and so tell how much of two texts agrees.
HALVINGS = [0, 1, 2, 3, 4, 4, *[5] * 6, *[6] * 8, *[7] * 8, *[8] * 6, *[9] * 4, 10, 11]
EMPTY = "00000000"
PUNCTUATION = "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|/\\*&%$#@+-=_~`^"


def terms(text: Column) -> Column:
    """Distinct lower-case terms: what stands between spaces and ASCII punctuation."""
    plain = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_remove(F.array_distinct(F.split(plain, " ")), "")


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(h, keeps) of the terms in the band, over all documents: a 64-bit hash, and a bit for each sub-lexicon that keeps the term.

    A document has few distinct terms on average, so at most mean / exp(-band[1])
    terms occur in a share of documents that the band allows: the lexicon does
    not grow with the number of documents.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(text_or_empty(text_col))).alias("t")).groupBy(F.xxhash64("t").alias("h")).agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    # A sub-lexicon keeps a term if low bits of a hash of its own are 0.
    bits = [F.when(F.xxhash64("h", F.lit(k)).bitwiseAND(_long((1 << h) - 1)) == 0, _long(1 << k)).otherwise(_long(0)) for k, h in enumerate(HALVINGS)]
    keeps = reduce(lambda x, y: x.bitwiseOR(y), bits)
    return df.where((idf >= band[0]) & (idf <= band[1])).select("h", keeps.alias("keeps"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _has(k: int):
    return lambda x: x["keeps"].bitwiseAND(_long(1 << k)) != 0


def signature(found: Column) -> Column:
    """Hashes of each sub-lexicon's terms among sorted (h, keeps), as hex strings; a zero string where it has none."""
    none = F.xxhash64(F.array().cast("array<struct<h:bigint,keeps:bigint>>"))
    hashes = F.array(*(F.xxhash64(F.filter(found, _has(k))) for k in range(len(HALVINGS))))
    return F.transform(hashes, lambda x: F.when(x == none, EMPTY).otherwise(F.lpad(F.lower(F.hex(x.bitwiseAND(_long(0xFFFFFFFF)))), 8, "0")))


def agreement(a: Column, b: Column) -> Column:
    """Equal hashes, plus 1000 times the sub-lexicons that have terms of either text."""
    pair = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 1001).otherwise(1000))
    return F.aggregate(pair, F.lit(0), lambda s, x: s + x)


def likeness(rest_a: Column, rest_b: Column, counted: Column) -> Column:
    """Share of sub-lexicons that agree; texts without lexicon terms agree if their terms are the same; 0 to 1."""
    return F.when(counted == 0, (rest_a == rest_b).cast("double")).otherwise((counted % 1000) / F.floor(counted / 1000))


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (part, place, halo, id, text, next) in descending id; after the last row the first is next.

    Ids are cut into ranges at approximate quantiles, so no task sees all rows;
    only rows that share one id can't be parted.
    The largest id of a range is added to the range above (the largest of all to
    the lowest one) as a halo row, where it follows the last row. Null ids come
    last; rows with the same id go by text.
    """
    bounds = ranges(docs, id_col, parts)
    where = below(F.col(id_col), bounds)
    tops = sorted(docs.groupBy(where.alias("part")).agg(F.max(id_col).alias("top")).collect()) if bounds else [(0, None)]
    size = len(bounds) + 1
    top, target = [None] * size, [0] * size
    for (part, value), above in zip(tops, [*tops[1:], tops[0]], strict=True):
        top[part], target[part] = value, above[0]
    tops_, targets = F.array(*(F.lit(v).cast("long") for v in top)), F.array(*(F.lit(v) for v in target))
    rows = docs.select(where.alias("own"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    copy = F.when(F.col("id").eqNullSafe(F.get(tops_, F.col("own"))), F.struct(F.get(targets, F.col("own")).alias("part"), F.lit(True).alias("halo")))
    rows = rows.select("id", "text", F.explode(F.array_compact(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("halo")), copy))).alias("x"))
    rows = rows.select("x.part", "x.halo", "id", "text")
    order = Window.partitionBy("part").orderBy("halo", F.col("id").desc_nulls_last(), "text")
    return rows.select("part", "halo", "id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many leading characters of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Texts are shuffled once, by range of id; exploding, looking terms up and
    collecting them again stay in that partitioning. The lexicon is broadcast if
    its counted size allows it (see ``lexicon``), else joined.

    Null texts are empty; a text without terms has a fingerprint too, equal for
    all such texts. Repeated rows and ids get a row each. A row alone is its own
    next. An empty table gives no rows; other columns aren't read.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = written(lexicon(docs, text_col, band), "lexicon")
    rows = with_next(docs, id_col, text_col, parts)
    both = rows.withColumn("edit", F.when(~F.col("halo"), edited(F.col("text"), F.col("next"))))
    both = both.select("part", "place", "halo", "id", "text", "edit", terms(F.col("text")).alias("own"), terms(F.coalesce("edit", F.lit(""))).alias("new"))
    all_of = lambda c: F.xxhash64(F.sort_array(c))
    head = F.struct("halo", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), all_of("own").alias("r0"), all_of("new").alias("r1"))
    none = F.lit(None)
    item = lambda side, t, h: F.struct(F.lit(side).alias("side"), t.cast("string").alias("t"), h.alias("head"))
    kind = "struct<halo:boolean,id:bigint,n_chars:bigint,edited_sha256:string,r0:bigint,r1:bigint>"
    items = F.concat(
        F.array(item(2, none, head)),
        F.transform("own", lambda t: item(0, t, none.cast(kind))),
        F.transform("new", lambda t: item(1, t, none.cast(kind))),
    )
    exploded = both.select("part", "place", F.explode(items).alias("x")).select("part", "place", "x.side", F.xxhash64("x.t").alias("h"), "x.head")
    exploded = exploded.join(F.broadcast(words) if fits_broadcast(words, 32) else words, "h", "left").where("keeps is not null or side = 2")
    of = lambda s: F.sort_array(F.collect_list(F.when((F.col("side") == s) & F.col("keeps").isNotNull(), F.struct("h", "keeps")))).alias(f"t{s}")
    grouped = exploded.groupBy("part", "place").agg(F.max("head").alias("head"), of(0), of(1))
    printed = grouped.select("part", "place", "head", signature(F.col("t0")).alias("a"), signature(F.col("t1")).alias("b"))
    order = Window.partitionBy("part").orderBy("place")
    printed = printed.select("*", F.lead("a").over(order).alias("c"), F.lead("head").over(order)["r0"].alias("rc")).where(~F.col("head.halo"))
    printed = printed.select("*", agreement(F.col("a"), F.col("b")).alias("ab"), agreement(F.col("a"), F.col("c")).alias("ac"))
    # a text without lexicon terms prints the hash of all of its terms
    shown = lambda c, rest: F.when(F.exists(c, lambda x: x != EMPTY), F.array_join(c, ".")).otherwise(F.concat(F.lit("all."), F.lower(F.hex(rest))))
    return printed.select(
        F.col("head.id").alias("doc_id"), "head.n_chars", "head.edited_sha256", shown("a", F.col("head.r0")).alias("fingerprint"), shown("b", F.col("head.r1")).alias("edited_fingerprint"),
        likeness(F.col("head.r0"), F.col("head.r1"), F.col("ab")).alias("near_edited"), likeness(F.col("head.r0"), F.col("rc"), F.col("ac")).alias("near_next"),
    )
