"""Byte statistics: histograms, entropy, windows, parity and printable runs.

Bytes are counted inside tasks, so that a byte is never a row: what leaves a
task has 256 rows at most for an artifact, or one row for a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def _texts(batch: pa.RecordBatch):
    """(row, bytes) of a batch's texts that aren't empty."""
    texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for row in np.flatnonzero(np.diff(at)).tolist():
        yield row, buf[at[row] : at[row + 1]]


def _counts(lanes: int):
    """Rows (artifact_id, lane, byte, n) of the bytes at offsets of each lane (offset modulo ``lanes``)."""

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for row, data in _texts(batch):
                for lane in range(lanes):
                    n = np.bincount(data[lane::lanes], minlength=256)
                    byte = np.flatnonzero(n)
                    rows += [row] * len(byte)
                    out.append(np.stack([np.full(len(byte), lane), byte, n[byte]]))
            if rows:
                lane, byte, n = np.concatenate(out, 1)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(lane, pa.int64()), pa.array(byte.astype(np.int32)), pa.array(n, pa.int64())], names=["artifact_id", "lane", "byte", "n"])

    return run


def _windows(size: int):
    """Rows (artifact_id, w, total, x) of each window of offsets: its bytes, and the sum of n * log2(n) over its byte values."""

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for row, data in _texts(batch):
                for w, at in enumerate(range(0, len(data), size)):
                    n = np.bincount(data[at : at + size])
                    n = n[n > 0]
                    rows.append(row)
                    out.append((w, int(n.sum()), float((n * np.log2(n)).sum())))
            if rows:
                w, total, x = zip(*out, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(w, pa.int64()), pa.array(total, pa.int64()), pa.array(x, pa.float64())], names=["artifact_id", "w", "total", "x"])

    return run


def _each(artifacts: DataFrame, function, columns: str) -> DataFrame:
    kind = artifacts.schema["artifact_id"].dataType.simpleString()
    return artifacts.select("artifact_id", F.col("text").cast("binary").alias("text")).mapInArrow(function, f"artifact_id {kind}, {columns}")


def histogram(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, byte, n): bytes are counted before the shuffle. Null and empty texts have no rows."""
    return _each(artifacts, _counts(1), "lane long, byte int, n long").groupBy("artifact_id", "byte").agg(F.sum("n").alias("n"))


def entropy(counted: DataFrame, *keys: str) -> DataFrame:
    """Bits a byte, distinct bytes, zero bytes and the share of printable ones of each group of (keys, byte, n)."""
    total = counted.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("x"), F.count("*").alias("distinct_bytes"),
        F.sum(F.when(F.col("byte").between(32, 126) | F.col("byte").isin(9, 10, 13), F.col("n")).otherwise(0)).alias("printable"),
        F.sum(F.when(F.col("byte") == 0, F.col("n")).otherwise(0)).alias("zeros"),
    )
    bits = F.greatest(F.lit(0.0), F.log2("total") - F.col("x") / F.col("total"))
    return total.select(*keys, "total", F.round(bits, 6).alias("bits"), "distinct_bytes", F.round(F.col("printable") / F.col("total"), 6).alias("printable_share"), "zeros")


def window_entropy(artifacts: DataFrame, size: int = 65536) -> DataFrame:
    """(artifact_id, windows, min_bits, max_bits, avg_bits) over tumbling windows of byte offsets; the last may be short. The average is cut to millionths."""
    each = _each(artifacts, _windows(size), "w long, total long, x double")
    each = each.withColumn("bits", F.round(F.greatest(F.lit(0.0), F.log2("total") - F.col("x") / F.col("total")), 6))
    return each.groupBy("artifact_id").agg(F.count("*").alias("windows"), F.min("bits").alias("min_bits"), F.max("bits").alias("max_bits"), (F.floor(F.round(F.sum("bits") * 1e6) / F.count("*")) / 1e6).alias("avg_bits"))


def top_bytes(counted: DataFrame, k: int = 16) -> DataFrame:
    """The k most frequent bytes of each artifact, smaller bytes first among equals; 256 rows an artifact at most are ranked."""
    order = Window.partitionBy("artifact_id").orderBy(F.col("n").desc(), "byte")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def parity_modes(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, parity, byte, n): the most frequent byte at even and at odd offsets, the lowest among equals."""
    counted = _each(artifacts, _counts(2), "lane long, byte int, n long").groupBy("artifact_id", F.col("lane").alias("parity"), "byte").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("artifact_id", "parity").orderBy(F.col("n").desc(), "byte")
    return counted.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def printable_runs(artifacts: DataFrame, least: int = 4) -> DataFrame:
    """(artifact_id, runs, longest, indicators): runs of printable ASCII, and which fixed words occur in them."""
    runs = F.regexp_extract_all("text", F.lit(f"[ -~]{{{least},}}"), F.lit(0))
    found = artifacts.select("artifact_id", runs.alias("runs"))
    low = F.lower(F.array_join("runs", "\n"))
    hits = F.array_sort(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in fixed.INDICATORS))))
    longest = F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0))
    return found.select("artifact_id", F.size("runs").cast("long").alias("runs"), longest.cast("long").alias("longest"), F.array_join(hits, ",").alias("indicators"))


def readable_strings(artifacts: DataFrame, k: int = fixed.STRINGS_REPORTED) -> DataFrame:
    """(artifact_id, value, score, rank): the printable runs of each artifact that say most, k at most.

    A run counts if it holds an indicator, or enough letters and readable signs. Equal values count once, with their best
    score; values stand in order of code points among equals. All runs are candidates.
    """
    low = F.lower("run")
    matched = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in fixed.INDICATORS), F.lit(0))
    letters, readable = (lambda c: F.regexp_count(c, F.lit("[A-Za-z]"))), (lambda c: F.regexp_count(c, F.lit(fixed.READABLE)))
    runs = artifacts.select("artifact_id", F.explode(F.regexp_extract_all("text", F.lit("[ -~]{4,}"), F.lit(0))).alias("run"))
    runs = runs.select("artifact_id", F.substring("run", 1, fixed.STRING_CHARS).alias("run")).withColumn("matched", matched)
    runs = runs.where((F.col("matched") > 0) | ((letters(F.col("run")) >= fixed.STRING_LETTERS) & (readable(F.col("run")) / F.length("run") >= fixed.STRING_SHARE)))
    value = F.substring("run", 1, fixed.STRING_VALUE_CHARS)
    runs = runs.select("artifact_id", value.alias("value"), "matched").groupBy("artifact_id", "value").agg(F.max("matched").alias("matched"))
    v = F.col("value")
    score = F.col("matched") * fixed.INDICATOR_POINTS + F.round(readable(v) / F.length(v) * fixed.SHARE_POINTS) + F.least(F.lit(fixed.LENGTH_POINTS), F.length(v)) + letters(v)
    order = Window.partitionBy("artifact_id").orderBy(F.col("score").desc(), "value")
    scored = runs.select("artifact_id", "value", score.cast("long").alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
