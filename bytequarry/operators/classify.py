"""Classification, detectors, and selection of a route with a margin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import control_share, count, java, masked, may_match, physical_lines


GENERIC = "generic-static"


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), ";")


def classify(artifacts: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, file_name, text, is_bytecode) with code, kind, dialect, confidence and reasons.

    Text is null where bytes aren't UTF-8, which makes an artifact binary unless
    it has the bytecode signature. The first rule that holds decides. All of it
    is one projection over the scan; of statement tokens two are enough.
    """
    text = F.coalesce("text", F.lit(""))
    out = artifacts.withColumn("code", masked(text))
    audit = [F.when(count(text, p) >= n, F.lit(name)) for name, p, n in fixed.AUDIT_SIGNALS]
    luau = [F.when(may_match(F.col("code"), p) & F.col("code").rlike(java(p)), F.lit(name)) for name, p in fixed.LUAU_SIGNALS]
    control = F.contains(text, F.lit("\0")) | (control_share(text) > fixed.CONTROL_SHARE)
    out = out.withColumns({"_audit": F.array_compact(F.array(*audit)), "_luau": F.array_compact(F.array(*luau)), "_tokens": F.col("code").rlike(java(rf"{fixed.STATEMENTS}[\s\S]*?{fixed.STATEMENTS}")), "_control": control})
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^./\\]+)$", 1))
    n_audit, n_luau = F.size("_audit"), F.size("_luau")
    rules = [
        (F.col("is_bytecode"), "lua-bytecode", "lua-5.1", F.lit(1.0), F.lit("signature")),
        (F.col("text").isNull(), "binary", "unknown", F.lit(0.98), F.lit("not UTF-8")),
        (F.col("_control"), "binary", "unknown", F.lit(0.9), F.lit("control bytes")),
        (n_audit >= 3, "vm-audit-ir", "vm-ir", F.least(F.lit(1.0), F.lit(0.65) + n_audit * F.lit(0.06)), F.array_join("_audit", ";")),
        ((n_luau > 0) | (ext == ".luau"), "luau-source", "luau", F.when(n_luau > 0, 0.88).otherwise(0.62), F.when(n_luau > 0, F.array_join("_luau", ";")).otherwise("extension")),
        (
            (ext == ".lua") | F.col("_tokens"), "lua-source", "lua-5.1", F.when((ext == ".lua") & F.col("_tokens"), 0.92).otherwise(0.7),
            _joined([F.when(ext == ".lua", F.lit("extension")), F.when(F.col("_tokens"), F.lit("statement tokens"))]),
        ),
        (F.lit(True), "text", "unknown", F.lit(0.7), F.lit("no syntax evidence")),
    ]

    fields = ("kind", "dialect", "confidence", "reasons")
    cases = [(r[0], F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(f) for f, v in zip(fields, r[1:], strict=True)))) for r in rules]
    out = out.withColumn("_first", reduce(lambda c, r: c.when(*r), cases[1:], F.when(*cases[0])))
    out = out.withColumns({f: F.col("_first")[f] for f in fields}).withColumn("confidence", F.round("confidence", 6))
    return out.drop("_audit", "_luau", "_tokens", "_control", "_first")


def signals(classified: DataFrame) -> DataFrame:
    """(artifact_id, signal, hits): what the classifier's signals match, listings in the text and extensions in masked code."""
    text = F.coalesce("text", F.lit(""))
    found = [(name, count(text, p)) for name, p, _ in fixed.AUDIT_SIGNALS] + [(name, count(F.col("code"), p)) for name, p in fixed.LUAU_SIGNALS]
    rows = F.array(*(F.struct(F.lit(name).alias("signal"), n.alias("hits")) for name, n in found))
    return classified.select("artifact_id", F.explode(rows).alias("s")).select("artifact_id", "s.*").where("hits > 0")


def counts(classified: DataFrame) -> DataFrame:
    """Classified artifacts with the numbers that detectors look at."""
    text = F.coalesce("text", F.lit(""))
    out = classified.withColumns({name: count(F.col("code") if on_code else text, p) for name, on_code, p in fixed.COUNTS})
    return out.withColumns({
        "n_chars": F.length(text).cast("long"),
        "n_lines": physical_lines(text),
        "loader_literals": sum((F.contains(text, F.lit(s)).cast("int") for s in fixed.LOADER_LITERALS), F.lit(0)),
        "loader_name": F.col("file_name").rlike(fixed.LOADER_NAME),
    })


def detections() -> Column:
    """What every detector says of a row with counts: an array of (plugin_id, confidence, evidence).

    Weights are added in their fixed order to the detector's base, kept within 0
    and 1 and rounded to three places.
    """
    rows = []
    for plugin, base in sorted(fixed.BASES.items()):
        own = [e for e in fixed.EVIDENCE if e[0] == plugin]
        score = reduce(lambda s, e: s + F.when(F.expr(e[2]), F.lit(e[3])).otherwise(0.0), own, F.lit(base))
        ids = F.array_join(F.array_compact(F.array(*(F.when(F.expr(e[2]), F.lit(e[1])) for e in own))), ";")
        rows.append(F.struct(F.lit(plugin).alias("plugin_id"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("confidence"), ids.alias("evidence")))
    return F.array(*rows)


def detect(counted: DataFrame) -> DataFrame:
    """(artifact_id, plugin_id, confidence, evidence): a row for each artifact and detector."""
    return counted.select("artifact_id", F.explode(detections()).alias("d")).select("artifact_id", "d.*")


def _route(first: Column, following: Column) -> list[Column]:
    """Columns of the selected route from the best family detector's (plugin_id, confidence) and the next one's."""
    margin = F.round(first["confidence"] - following["confidence"], 6)
    high = first["confidence"] >= fixed.SELECT_AT
    clear = following.isNull() | (margin >= fixed.SELECT_MARGIN)
    return [
        F.when(high & clear, first["plugin_id"]).otherwise(GENERIC).alias("plugin_id"),
        (high & ~clear).cast("int").alias("ambiguous"),
        first["plugin_id"].alias("first_id"),
        first["confidence"].alias("first_confidence"),
        margin.alias("margin"),
    ]


def select_route(detections: DataFrame) -> DataFrame:
    """(artifact_id, plugin_id, ambiguous, first_id, first_confidence, margin): the family detector that leads clearly, else the generic one.

    Four rows an artifact at most, so the ranking window is bounded.
    """
    order = Window.partitionBy("artifact_id").orderBy(F.col("confidence").desc(), "plugin_id")
    one = F.struct("plugin_id", "confidence")
    family = detections.where(F.col("plugin_id") != GENERIC)
    ranked = family.withColumns({"rank": F.row_number().over(order), "first": one, "next": F.lead(one).over(order)}).where("rank = 1")
    return ranked.select("artifact_id", *_route(F.col("first"), F.col("next")))


def with_route(counted: DataFrame) -> DataFrame:
    """The same choice within the row: counted artifacts with the columns of their route, without a shuffle."""
    family = F.filter(detections(), lambda d: d["plugin_id"] != GENERIC)
    best = F.array_sort(F.transform(family, lambda d: F.struct((-d["confidence"]).alias("o"), d["plugin_id"].alias("plugin_id"), d["confidence"].alias("confidence"))))
    return counted.withColumn("_best", best).select(*counted.columns, *_route(F.get("_best", F.lit(0)), F.get("_best", F.lit(1))))


def static_facts(classified: DataFrame) -> DataFrame:
    """Hashes, sizes and counts of functions, calls, varargs and register names; one row an artifact."""
    code, text = F.col("code"), F.coalesce("text", F.lit(""))
    names = F.size(F.array_distinct(F.regexp_extract_all(code, F.lit(java(fixed.REGISTERS)), F.lit(0))))
    return classified.select(
        "artifact_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("n_bytes"), physical_lines(text).alias("n_lines"),
        count(code, r"\bfunction\b").alias("functions"), count(code, fixed.CALLS).alias("calls"), count(code, fixed.VARARGS).alias("varargs"),
        count(code, fixed.REGISTERS).alias("registers"), names.cast("long").alias("register_names"),
    )


def hazards(classified: DataFrame, probes=None) -> DataFrame:
    """(artifact_id, probe, occurrences) of probes that match masked code."""
    rows = F.array(*(F.struct(F.lit(i).alias("probe"), count(F.col("code"), p).alias("occurrences")) for i, p in probes or fixed.HAZARDS))
    return classified.select("artifact_id", F.explode(rows).alias("h")).select("artifact_id", "h.*").where("occurrences > 0")
