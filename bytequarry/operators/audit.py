"""Validation of audit listings, diagnostics and required outputs, by recomputing and comparing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import java


def audit_lines(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, line_no, line, function_no, function): lines of listings within their functions.

    A function lasts until the next one's first line; lines before the first
    belong to none. The window is over one listing.
    """
    lines = artifacts.select("artifact_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    name = F.regexp_extract("line", fixed.FUNCTION, 1)
    order = Window.partitionBy("artifact_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("own", F.when(name != "", name))
    return lines.withColumns({"function_no": F.count("own").over(order), "function": F.last("own", ignorenulls=True).over(order)}).drop("own").where("function_no > 0")


def labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label definitions and goto references: (artifact_id, function_no, function, label) each."""
    of = lambda p: lines.select("artifact_id", "function_no", "function", F.explode(F.regexp_extract_all("line", F.lit(java(p)), F.lit(1))).alias("label"))
    return of(fixed.LABEL), of(fixed.GOTO)


def label_scope(lines: DataFrame) -> DataFrame:
    """One row a function: definitions, references, duplicate labels, and targets that no label of the function defines."""
    key = ["artifact_id", "function_no", "function"]
    defined, used = labels(lines)
    defs = defined.groupBy(*key, "label").agg(F.count("*").alias("n"))
    uses = used.groupBy(*key, "label").agg(F.count("*").alias("n"))
    lost = uses.join(defs.select(*key, "label"), [*key, "label"], "left_anti")
    a = defs.groupBy(*key).agg(F.sum("n").alias("definitions"), F.count_if(F.col("n") > 1).alias("duplicates"))
    b = uses.groupBy(*key).agg(F.sum("n").alias("uses"))
    c = lost.groupBy(*key).agg(F.count("*").alias("unresolved"))
    out = lines.select(*key).distinct()
    for part in (a, b, c):
        out = out.join(part, key, "left")
    return out.na.fill(0, ["definitions", "duplicates", "uses", "unresolved"])


def duplicate_labels(lines: DataFrame) -> DataFrame:
    defined, _ = labels(lines)
    return defined.groupBy("artifact_id", "function_no", "label").agg(F.count("*").alias("n")).where("n > 1")


def unresolved_gotos(lines: DataFrame) -> DataFrame:
    defined, used = labels(lines)
    key = ["artifact_id", "function_no", "label"]
    return used.groupBy(*key).agg(F.count("*").alias("n")).join(defined.select(*key).distinct(), key, "left_anti")


def metadata(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, decoded, reachable, patches, omitted): sums of the numbers that listings state."""
    total = lambda p, k: F.aggregate(F.regexp_extract_all("text", F.lit(p), F.lit(k)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return artifacts.select("artifact_id", total(fixed.METADATA, 1).alias("decoded"), total(fixed.METADATA, 2).alias("reachable"), total(fixed.PATCHES, 1).alias("patches"), total(fixed.PATCHES, 2).alias("omitted"))


def merge_diagnostics(analysis: DataFrame, validation: DataFrame) -> DataFrame:
    """Diagnostics of the analysis, and those of validation whose (code, message) are new to the artifact."""
    key = ["artifact_id", "code", "message"]
    return analysis.unionByName(validation.join(analysis.select(*key).distinct(), key, "left_anti").select(*analysis.columns))


def missing_outputs(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required (artifact_id, role) without a present output that isn't empty."""
    return required.join(present.where("n_bytes > 0").select("artifact_id", "role").distinct(), ["artifact_id", "role"], "left_anti")
