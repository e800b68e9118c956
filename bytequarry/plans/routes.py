"""Whole routes over artifacts: classify, detect, select, and the outputs of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import inventory


def detect(artifacts: DataFrame) -> DataFrame:
    """Artifacts with their kind and the selected route: one scan and no shuffle."""
    routed = C.with_route(C.counts(C.classify(artifacts)))
    return routed.select("artifact_id", "file_name", "kind", "dialect", "confidence", "plugin_id", "ambiguous", "first_id", "first_confidence", "margin")


def analyze(artifacts: DataFrame) -> DataFrame:
    """Outputs (artifact_id, role, file_name, media_type, body): the original, a report and a behaviour inventory of each artifact."""
    classified = C.classify(artifacts)
    original = classified.select("artifact_id", F.lit("original").alias("role"), "file_name", F.when(F.col("kind") == "binary", "application/octet-stream").otherwise("text/x-lua").alias("media_type"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    facts = C.static_facts(classified)
    report = facts.select("artifact_id", F.lit("report"), F.lit("report.json"), F.lit("application/json"), F.to_json(F.struct(*facts.columns)).cast("binary"))
    found = inventory.capabilities(classified)
    line = F.concat_ws(" ", "category", "api", "occurrences", "lines")
    behavior = found.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary").alias("body"))
    return original.union(report).union(behavior.select("artifact_id", F.lit("behavior"), F.lit("behavior.txt"), F.lit("text/plain"), "body"))
