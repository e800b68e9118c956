"""Capability and URL inventories."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import count, java


def capabilities(sources: DataFrame, code_col: str = "code") -> DataFrame:
    """(artifact_id, category, api, occurrences, lines): what code mentions, with the first lines that do.

    Each spec is a literal pattern of one projection, tried only where a word
    that all its matches hold is in the code; only where it is found are the
    code's lines looked at, those that hold the word. No pattern reaches over a
    line's end but through white space, so counts are of the whole code. Nothing
    is shuffled. Rows without a find go only after the explode: a filter before it
    would move below the projection and mask the text again for each spec.
    """
    code = F.col(code_col)
    words = lambda p: sorted(set(re.findall("[A-Za-z_]{4,}", re.sub(r"\\.", " ", p))))
    some = lambda p, t: F.greatest(F.lit(False), *(F.contains(t, F.lit(w)) for w in words(p)))

    def spec(category: str, api: str, p: str):
        at = F.filter(F.transform("lines", lambda x, k: F.when(some(p, x), F.when(x.rlike(java(p)), k + 1))), lambda k: k.isNotNull())
        row = F.struct(F.lit(category).alias("category"), F.lit(api).alias("api"), F.col(f"_{api}").alias("occurrences"), F.array_join(F.slice(at, 1, fixed.CAPABILITY_LINES), ",").alias("lines"))
        return F.when(F.col(f"_{api}") > 0, row)

    counts = [F.when(some(p, code), count(code, p)).alias(f"_{a}") for _, a, p in fixed.CAPABILITIES]
    rows = sources.select("artifact_id", F.split(code, "\n").alias("lines"), *counts)
    rows = rows.select("artifact_id", F.explode_outer(F.array_compact(F.array(*(spec(*c) for c in fixed.CAPABILITIES)))).alias("s")).where("s is not null")
    return rows.select("artifact_id", "s.category", "s.api", "s.occurrences", "s.lines")


def urls(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, line, url, scheme), distinct: URLs without closing punctuation, up to a fixed length."""
    lines = sources.select("artifact_id", F.posexplode(F.split(text_col, "\n")).alias("at", "text"))
    found = lines.where(F.contains(F.lower("text"), F.lit("http"))).select("artifact_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("text", F.lit(java(fixed.URL)), F.lit(0))).alias("url"))
    found = found.withColumn("url", F.regexp_replace("url", r"[),.;]+$", "")).where(F.length("url") <= fixed.URL_CHARS)
    return found.withColumn("scheme", F.lower(F.regexp_extract("url", "^([A-Za-z]+):", 1))).distinct()


def loader_surface(classified: DataFrame) -> DataFrame:
    """Counts of control words and method calls of each artifact."""
    code = F.col("code")
    words = {w: count(code, rf"\b{w}\b").alias(f"n_{w}") for w in ("if", "for", "while", "repeat", "continue", "return")}
    methods = F.regexp_extract_all(code, F.lit(r":\s*([A-Za-z_]\w*)\s*\("), F.lit(1))
    return classified.select("artifact_id", *words.values(), F.size(methods).cast("long").alias("method_calls"), F.size(F.array_distinct(methods)).cast("long").alias("distinct_methods"))


def budget_prefix(sources: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """(artifact_id, line, running): the first lines of each artifact whose bytes, with line ends, fit a budget."""
    lines = sources.select("artifact_id", F.posexplode(F.split(text_col, "\n")).alias("at", "text"))
    order = Window.partitionBy("artifact_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("running", F.sum(F.octet_length("text") + 1).over(order))
    return lines.where(F.col("running") <= budget).select("artifact_id", (F.col("at") + 1).cast("long").alias("line"), "running")


def line_bytes(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, line, size): bytes of each line with its line end; only sizes become rows."""
    sizes = F.transform(F.split(text_col, "\n"), lambda t: (F.octet_length(t) + 1).cast("long"))
    return sources.select("artifact_id", F.posexplode(sizes).alias("at", "size")).select("artifact_id", (F.col("at") + 1).cast("long").alias("line"), "size")


def budget_selection(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The rows of each key that fit a budget, taken in order: one that doesn't fit is skipped and the next is tried.

    What is left after a skip depends on all that was taken before, so no window
    sum says it: sorted rows are folded as they pass, and a task holds one number,
    however long a key's rows are. Rows larger than the budget never move. A null
    key is a key; rows of null size are left out, equal places go by size.
    """

    def fold(batches):
        last, left = object(), 0
        for batch in batches:
            keep = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if k != last:
                    last, left = k, budget
                keep.append(n <= left)
                left -= n if n <= left else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitting = rows.where(F.col(size) <= budget).repartition(parts, key).sortWithinPartitions(key, order, size)
    return fitting.mapInArrow(fold, rows.schema)


def loader_facts(classified: DataFrame) -> DataFrame:
    """What a loader's masked code declares: functions, named handlers and library aliases in order, entry point, distinct keys of two digits and more, buffer functions.

    Names before a sign of equality are looked for only where what must follow it is found: that begins at the sign,
    a name at every word.
    """
    code = F.col("code")
    library = r"(?:math|string|bit32|buffer|table|coroutine)(?:\s*\.\s*[A-Za-z_]\w*)?"
    assigned = lambda p, k: F.when(code.rlike(rf"=\s*+{p}"), F.regexp_extract_all(code, F.lit(java(rf"\b([A-Za-z_]\w*+)\s*+=\s*+{p}")), F.lit(k)))
    none = F.array().cast("array<string>")
    handlers = F.coalesce(assigned(r"function\s*\(", 1), none)
    names, values = assigned(f"({library})", 1), F.transform(assigned(f"({library})", 2), lambda v: F.regexp_replace(v, r"\s+", ""))
    aliases = F.coalesce(F.zip_with(names, values, lambda n, v: F.concat(n, F.lit(" -> "), v)), none)
    keys = F.regexp_extract_all(code, F.lit(r"\[\s*(\d{2,})\s*\]"), F.lit(1))
    api = F.array_compact(F.array(*(F.when(F.contains(code, F.lit(a)), F.when(code.rlike(java(rf"\b{a}\b")), F.lit(a))) for a in fixed.BUFFER_APIS)))
    return classified.select(
        "artifact_id", count(code, r"\bfunction\b").alias("functions"), F.array_join(F.array_distinct(handlers), ",").alias("handlers"),
        F.nullif(F.regexp_extract(code, r"\}\)\s*:\s*([A-Za-z_]\w*)\s*\(\s*\)\s*;?\s*\z", 1), F.lit("")).alias("entrypoint"), F.array_join(aliases, ",").alias("aliases"),
        F.size(F.array_distinct(keys)).cast("long").alias("numeric_keys"), F.array_join(api, ",").alias("buffer_apis"),
    )


def called_methods(classified: DataFrame, k: int = fixed.METHODS_REPORTED) -> DataFrame:
    """(artifact_id, method, n, rank): the methods that each artifact's masked code calls most, by name among equals."""
    calls = classified.select("artifact_id", F.explode_outer(F.regexp_extract_all("code", F.lit(r":\s*([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("method")).where("method is not null")
    order = Window.partitionBy("artifact_id").orderBy(F.col("n").desc(), "method")
    return calls.groupBy("artifact_id", "method").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
