"""Encoded streams in source text: finding them, and decoding base-85 bodies, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def encoded_streams(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, ordinal, literal, body): long-bracket and quoted literals that start with the stream mark, in order.

    Escapes in quoted literals stay as they are. Null and empty texts have none. No shuffle.
    """
    found = sources.select("artifact_id", F.posexplode(F.regexp_extract_all(text_col, F.lit(fixed.STREAM), F.lit(0))).alias("at", "literal"))
    body = F.regexp_replace(F.regexp_replace("literal", r"""^(?:\[=*\[|["'])""", ""), r"""(?:\]=*\]|["'])\z""", "")
    return found.select("artifact_id", (F.col("at") + 1).cast("long").alias("ordinal"), "literal", body.alias("body"))


def ascii85(body: Column, little: bool) -> Column:
    """The bytes of base-85 text in groups of five signs; null if a group is incomplete, has other signs or is too large.

    A ``z`` between groups stands for four zero bytes. Empty text gives no bytes.
    """
    groups = F.regexp_extract_all(body, F.lit("z|[!-u]{5}"), F.lit(0))
    digit = lambda g, k: (F.ascii(F.substring(g, k, 1)) - 33).cast("long")
    value = lambda g: (((digit(g, 1) * 85 + digit(g, 2)) * 85 + digit(g, 3)) * 85 + digit(g, 4)) * 85 + digit(g, 5)
    words = F.transform(groups, lambda g: F.when(g == "z", F.lit(0).cast("long")).otherwise(value(g)))
    text = lambda w: F.lpad(F.hex(w), 8, "0")
    turned = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    parts = F.transform(words, (lambda w: turned(text(w))) if little else text)
    whole = F.length(F.array_join(groups, "")) == F.length(body)
    return F.when(whole & ~F.exists(words, lambda w: w > 0xFFFFFFFF), F.unhex(F.array_join(parts, "")))


def candidates(streams: DataFrame, body_col: str = "body", declared_col: str | None = None) -> DataFrame:
    """Streams with rank, skip, little and data: every reading of a body that decodes, by preference.

    A reading leaves out so many signs at the start (one less than what the stream
    declares, if it does, then the fixed ones) and has an order of bytes. Ten rows
    a stream at most, made in place.
    """
    skips = [F.lit(s) for s in fixed.STREAM_SKIPS]
    if declared_col:
        skips.insert(0, F.when(F.col(declared_col) >= 1, F.col(declared_col) - 1).cast("int"))
    tries = F.array_distinct(F.array_compact(F.array(*skips)))
    rows = streams.select("*", F.posexplode(tries).alias("at", "skip"))
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("little")).withColumn("rank", 2 * F.col("at") + F.when(F.col("little"), 1).otherwise(2)).drop("at")
    rest = F.expr(f"substring({body_col}, skip + 1)")
    data = F.when(F.col("little"), ascii85(rest, True)).otherwise(ascii85(rest, False))
    return rows.withColumn("data", data).where((F.octet_length("data") > 0) & (F.length(body_col) > F.col("skip")))


def accepted(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys, skip, little, data) of each stream's preferred reading."""
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct("skip", "little", "data"), "rank").alias("best"))
    return best.select(*keys, "best.*")


def unescaped(literal: Column) -> Column:
    """What a quoted literal's text stands for: decimal and control escapes, and any other sign after a backslash as itself."""
    named = F.create_map(*(F.lit(x) for pair in fixed.ESCAPES.items() for x in pair))
    parts = F.regexp_extract_all(literal, F.lit(r"\\\d{1,3}|\\[\s\S]|[^\\]+"), F.lit(0))
    one = lambda t: F.when(~t.startswith("\\"), t).when(t.rlike(r"^\\\d"), F.char(F.substring(t, 2, 3).cast("int"))).otherwise(F.coalesce(F.try_element_at(named, F.substring(t, 2, 1)), F.substring(t, 2, 1)))
    return F.when(F.contains(literal, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(literal)


def stream_pairs(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, streams: array of (text, declared), at least two): the streams of each text in their order.

    text is what the literal stands for, marks included; declared the index that
    a call gives after it (at most four digits), or null. Texts with fewer streams
    have no row. No shuffle.
    """
    after = F.lit(f"(?:{fixed.STREAM})(?:{fixed.DECLARED})?")
    every = lambda k: F.regexp_extract_all(text_col, after, F.lit(k))
    plain = lambda t: F.regexp_replace(t, fixed.DECLARED + r"\z", "")
    quoted = lambda t: unescaped(F.substring(t, F.lit(2), F.length(t) - 2))
    body = lambda t: F.when(t.startswith("["), F.regexp_replace(F.regexp_replace(t, r"^\[=*\[", ""), r"\]=*\]\z", "")).otherwise(quoted(t))
    both = F.zip_with(every(0), every(2), lambda t, d: F.struct(body(plain(t)).alias("text"), F.nullif(d, F.lit("")).cast("int").alias("declared")))
    # Asked of the text: a condition on the streams would read them once more.
    several = F.regexp_count(F.col(text_col), after) >= 2
    return sources.where(several).select("artifact_id", both.alias("streams"))


def accepted_pairs(pairs: DataFrame) -> DataFrame:
    """(artifact_id, streams, skip, little, data: array of bytes) of texts whose streams all decode in one way.

    Ways are tried in order: what the first stream declares, then the fixed
    numbers of signs to leave out, for each first little-endian words. The first
    way counts in which every stream decodes and the first one's bytes begin as
    compressed data do, with zero. Texts without such a way have no row. All in
    the row: a stream's bytes are never shuffled.
    """
    declared = F.col("streams")[0]["declared"] - 1
    skips = F.array_distinct(F.array_compact(F.array(F.when(declared >= 0, declared), *(F.lit(k) for k in fixed.STREAM_SKIPS))))
    ways = F.flatten(F.transform(skips, lambda k: F.array(*(F.struct(k.alias("skip"), F.lit(little).alias("little")) for little in (True, False)))))
    rest = lambda t, w: F.substring(t["text"], w["skip"] + 1, F.length(t["text"]))
    data = lambda w: F.transform("streams", lambda t: F.when(F.length(t["text"]) > w["skip"], F.when(w["little"], ascii85(rest(t, w), True)).otherwise(ascii85(rest(t, w), False))))
    read = F.transform(ways, lambda w: F.struct(w["skip"].alias("skip"), w["little"].alias("little"), data(w).alias("data")))
    good = F.filter(read, lambda r: ~F.exists(r["data"], lambda d: d.isNull() | (F.octet_length(d) == 0)) & (F.substring(F.hex(r["data"][0]), 1, 2) == "00"))
    first = pairs.select("artifact_id", F.size("streams").alias("_n"), F.explode(F.slice(good, 1, 1)).alias("_first"))
    return first.select("artifact_id", F.col("_n").alias("streams"), "_first.skip", "_first.little", "_first.data")
