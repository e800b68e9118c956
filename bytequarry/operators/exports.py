"""Results as files that people and programs read: JSON lines, names, Markdown.

Lines are columns of the rows they stand for; nothing is collected. Only
``write_lines`` writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

EXTENSIONS = ("lua", "luau", "luac", "txt")


def _groups(value: Column) -> Column:
    """How many bytes a number below 2**53 takes in groups of seven bits."""
    return F.greatest(F.lit(1), *(F.when(F.shiftrightunsigned(value, 7 * k) > 0, k + 1) for k in range(1, 8))).cast("long")


def instruction_lines(instructions: DataFrame, section: Column) -> DataFrame:
    """(section, prototype, pc, line): a JSON array of section, prototype, pc, first byte, the four words and their bytes.

    First bytes count from the prototype's first instruction; a running sum within the prototype gives them.
    """
    words = ("word_a", "raw_opcode", "word_n", "word_q")
    rows = instructions.select(section.alias("section"), "prototype", "pc", *words, *(_groups(F.col(w).cast("long")).alias(f"n_{w}") for w in words))
    size = sum((F.col(f"n_{w}") for w in words[1:]), F.col(f"n_{words[0]}"))
    order = Window.partitionBy("section", "prototype").orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(size).over(order) - size)
    cells = ("section", "prototype", "pc", "start", *words, *(f"n_{w}" for w in words))
    return rows.select("section", "prototype", "pc", F.concat(F.lit("["), F.concat_ws(",", *(F.col(c).cast("string") for c in cells)), F.lit("]")).alias("line"))


def prototype_lines(prototypes: DataFrame, captures: DataFrame, root: Column) -> DataFrame:
    """(section, prototype, line): a JSON object of each prototype with its captures in order.

    prototypes: (section, prototype, instructions, selector, max_stack); captures: (prototype, index, encoded), of which a prototype has 255 at most.
    """
    cut = F.array(F.col("index"), F.col("encoded"), F.col("encoded") % 4, F.floor(F.col("encoded") / 4))
    lists = captures.groupBy("prototype").agg(F.array_sort(F.collect_list(cut)).alias("captures"))
    rows = prototypes.withColumn("root", root).join(lists, "prototype", "left")
    none = F.expr("cast(array() as array<array<bigint>>)")
    columns = [F.col(c) for c in ("section", "prototype", "instructions", "selector", "max_stack", "root")]
    return rows.select("section", "prototype", F.to_json(F.struct(*columns, F.coalesce("captures", none).alias("captures"))).alias("line"))


def constant_lines(constants: DataFrame) -> DataFrame:
    """(section, index, line): JSON objects of constants (section, index, kind, value), by kind string, integer, float or boolean.

    Texts keep their bytes as base 64, so nothing is lost; numbers keep their exact decimal form as a string.
    """
    value = F.col("value")
    head = [F.col(c) for c in ("section", "index", "kind")]
    text = F.struct(*head, F.octet_length(value).alias("byteLength"), value.alias("utf8Text"), F.replace(F.base64(value.cast("binary")), F.lit("\r\n"), F.lit("")).alias("encodedBase64"))
    number = F.struct(*head, value.alias("exactDecimal"))
    truth = F.struct(*head, (value == "true").alias("value"))
    line = F.when(F.col("kind") == "string", F.to_json(text)).when(F.col("kind") == "boolean", F.to_json(truth)).otherwise(F.to_json(number))
    return constants.select("section", "index", line.alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines in their order as gzipped text below a new folder: ranges of the order become files, sorted within each."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("errorifexists").option("compression", "gzip").text(path)


def output_names(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, role, file_name): names of each artifact's original and readable outputs.

    artifacts: (artifact_id, file_name, kind, readable); readable is null, source-code, register-pseudocode or vm-loader.
    """
    ending = F.lower(F.regexp_extract("file_name", r"\.([^./\\]+)$", 1))
    original = F.concat(F.lit("original."), F.when(ending.isin(*EXTENSIONS), ending).otherwise("bin"))
    readable = (
        F.when(F.col("readable") == "register-pseudocode", "readable-ir.txt").when(F.col("readable") == "vm-loader", "readable-loader.lua")
        .when(F.col("readable").isNotNull() & (F.col("kind") == "luau-source"), "readable.luau").when(F.col("readable").isNotNull(), "readable.lua")
    )
    pairs = F.array(F.struct(F.lit("original").alias("role"), original.alias("name")), F.struct(F.lit("readable").alias("role"), readable.alias("name")))
    return artifacts.select("artifact_id", F.explode(F.filter(pairs, lambda p: p["name"].isNotNull())).alias("p")).select("artifact_id", "p.role", F.col("p.name").alias("file_name"))


def media_type(text: Column) -> Column:
    """What a text is delivered as: source if nearly all its signs are printable; null (no UTF-8) and empty text are bytes."""
    kept = F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.when(kept / F.when(text != "", F.length(text)) > fixed.PRINTABLE_SHARE, fixed.MEDIA_SOURCE).otherwise(fixed.MEDIA_BYTES)


def hex_preview(content: Column, n: int = 64) -> Column:
    """The first bytes in hexadecimal, two digits each, with a space between."""
    return F.trim(F.regexp_replace(F.lower(F.hex(F.substring(content, 1, n))), "(..)", "$1 "))


def is_lua51(content: Column) -> Column:
    """Whether the first five bytes are the signature and version of a Lua 5.1 chunk."""
    return F.hex(F.substring(content, 1, 5)) == fixed.LUA51_SIGNATURE


def diagnostics_report(diagnostics: DataFrame) -> DataFrame:
    """(artifact_id, body): Markdown of each artifact's warnings and errors in order of code and message; infos don't count.

    Rows: (artifact_id, severity, code, message). Artifacts with none have a report that says so.
    """
    entry = F.concat(F.lit("- **"), F.upper("severity"), F.lit(" - "), F.col("code"), F.lit("**: "), F.col("message"))
    rows = diagnostics.withColumn("entry", F.when(F.col("severity") != "info", F.struct("code", "message", entry.alias("entry"))))
    lists = rows.groupBy("artifact_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    body = F.when(F.size("entries") == 0, "No warnings or errors were reported.").otherwise(F.array_join(F.transform("entries", lambda e: e["entry"]), "\n"))
    return lists.select("artifact_id", F.concat(F.lit("# Warnings\n\n"), body, F.lit("\n")).alias("body"))


def behavior_report(artifacts: DataFrame, capabilities: DataFrame, urls: DataFrame) -> DataFrame:
    """(artifact_id, body): Markdown of what each artifact's code mentions: capabilities by category and name, then URLs by line."""
    found = F.concat(F.lit("- **"), "category", F.lit(" / "), "api", F.lit("**: "), F.col("occurrences").cast("string"), F.lit(" occurrence(s); line(s) "), F.regexp_replace("lines", ",", ", "))
    caps = capabilities.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("category", "api", found.alias("entry")))).alias("caps"))
    seen = F.concat(F.lit("- Line "), F.col("line").cast("string"), F.lit(": `"), "url", F.lit("`"))
    links = urls.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("line", "url", seen.alias("entry")))).alias("links"))
    rows = artifacts.select("artifact_id").join(caps, "artifact_id", "left").join(links, "artifact_id", "left")
    text = lambda c: F.array_join(F.transform(c, lambda e: e["entry"]), "\n")
    first = F.when(F.col("caps").isNull(), "No configured capability API references were found.\n").otherwise(F.concat(F.lit("## Capability references\n\n"), text("caps"), F.lit("\n")))
    second = F.when(F.col("links").isNull(), "").otherwise(F.concat(F.lit("\n## URLs\n\n"), text("links"), F.lit("\n")))
    return rows.select("artifact_id", F.concat(F.lit("# Static behavior inventory\n\n"), first, second).alias("body"))
