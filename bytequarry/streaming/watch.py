"""Files that arrive in a folder are classified as they come; stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import classify
from ..sources.files import from_bytes

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of a stream over the files below ``path``."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    return from_bytes(files.select(F.col("path").alias("artifact_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content"))


def start(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append (artifact_id, file_name, kind, dialect, confidence, reasons) of each new file to Parquet at ``out``."""
    rows = classify(arriving(spark, path)).select("artifact_id", "file_name", "kind", "dialect", "confidence", "reasons")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
