"""Command line: ``python -m bytequarry detect PATH``, ``analyze PATH --out FOLDER`` or ``plugins``; JSON to standard output.

PATH is a file or a folder, in any file system that Spark reads. Files are looked
at by Spark; only a line of facts for each comes to the driver, one at a time.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import classify
from .plans import routes
from .sources import files

_SUMMARY = ("artifact_id", "file_name", "kind", "dialect", "confidence")


def _lines(df, out: TextIO) -> int:
    n = 0
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False), file=out)
        n += 1
    return n


def detect(spark: SparkSession, path: str, out: TextIO) -> int:
    """A line a file: its size, its class with reasons, what each detector says, and the selected route. Status 1 if there is no file."""
    counted = classify.counts(classify.classify(files.read_files(spark, path)))
    chosen = classify.with_route(counted.withColumn("detections", classify.detections()).drop("content"))
    rows = chosen.select(*_SUMMARY, "n_bytes", "reasons", "detections", F.struct("plugin_id", "ambiguous", "first_id", "first_confidence", "margin").alias("selection"))
    return 0 if _lines(rows, out) else 1


def analyze(spark: SparkSession, path: str, folder: str, out: TextIO) -> int:
    """Write the outputs of all files and their manifest below a new folder; a line for each manifest row. Status 1 if there is no file, 2 if an artifact was left out as too large."""
    artifacts = files.read_files(spark, path)
    manifest = files.write_bundle(routes.analyze(artifacts), folder)
    if not _lines(manifest.orderBy("artifact_id", "role"), out):
        return 1
    return 0 if manifest.select("artifact_id").distinct().count() == artifacts.count() else 2


def plugins(out: TextIO) -> int:
    """A line a detector: its id, its base confidence, and the evidence that it weighs."""
    for name, base in sorted(fixed.BASES.items()):
        print(json.dumps({"plugin_id": name, "base": base, "evidence": {e[1]: e[3] for e in fixed.EVIDENCE if e[0] == name}}), file=out)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None, out: TextIO = sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="bytequarry", description="Kind, route and inventories of scripts and bytecode.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("detect", help="class, detections and selected route of every file").add_argument("path")
    run = commands.add_parser("analyze", help="write originals, reports and inventories with a manifest")
    run.add_argument("path")
    run.add_argument("--out", required=True, help="a folder that doesn't exist yet")
    commands.add_parser("plugins", help="the detectors and what they weigh")
    given = parser.parse_args(args)
    if given.command == "plugins":
        return plugins(out)
    spark = spark or SparkSession.builder.appName("bytequarry").getOrCreate()
    return detect(spark, given.path, out) if given.command == "detect" else analyze(spark, given.path, given.out, out)


if __name__ == "__main__":
    sys.exit(main())
