"""Artifacts from files, and result bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

EXTENSIONS = ("lua", "luau", "luac", "txt")
MAX_INPUT_BYTES = 10 << 20
MAX_OUTPUT_BYTES = 40 << 20


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """Artifacts of the files below ``path`` with known extensions and at most ``max_bytes`` bytes.

    Larger files are never read: the length filter reaches the scan. Names match
    whatever their case. (artifact_id, file_name, n_bytes, content, text,
    is_bytecode); text is null where the content isn't UTF-8, and a byte order
    mark is dropped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length") <= max_bytes)
    return from_bytes(files.select(F.col("path").alias("artifact_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content"))


def from_bytes(rows: DataFrame) -> DataFrame:
    """Artifacts of rows (artifact_id, file_name, content); null content is empty."""
    content = F.coalesce("content", F.lit(b""))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\\ufeff", ""))
    signed = F.hex(F.substring(content, 1, 4)) == fixed.LUA_SIGNATURE
    return rows.select("artifact_id", "file_name", F.octet_length(content).cast("long").alias("n_bytes"), content.alias("content"), text.alias("text"), signed.alias("is_bytecode"))


def from_text(rows: DataFrame, id_col: str, name, text_col: str) -> DataFrame:
    """Artifacts of a table with a text column; ``name`` is a column expression."""
    return rows.select(F.col(id_col).alias("artifact_id"), name.alias("file_name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("is_bytecode"))


def artifact_records(outputs: DataFrame) -> DataFrame:
    """Manifest rows of outputs (artifact_id, role, file_name, media_type, body): their lengths and hashes."""
    return outputs.select("artifact_id", "role", "file_name", "media_type", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha256"))


def write_bundle(outputs: DataFrame, path: str, max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Write outputs and their manifest to new folders below ``path``; returns the manifest.

    An artifact whose outputs exceed ``max_bytes`` is left out before anything is
    written. Writing fails if a folder exists. The manifest comes last, so a
    bundle without it is incomplete.
    """
    total = outputs.groupBy("artifact_id").agg(F.sum(F.octet_length("body")).alias("total")).where(F.col("total") <= max_bytes)
    kept = outputs.join(total.select("artifact_id"), "artifact_id", "left_semi")
    kept.write.mode("errorifexists").partitionBy("role").parquet(f"{path}/outputs")
    manifest = artifact_records(outputs.sparkSession.read.schema(kept.schema).parquet(f"{path}/outputs"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return outputs.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def changed_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest rows that a second reading doesn't confirm: missing, unexpected or different files."""
    keys = ["artifact_id", "file_name"]
    a, b = (x.select(*keys, "media_type", "n_bytes", "sha256") for x in (expected, actual))
    joined = a.alias("a").join(b.alias("b"), keys, "full")
    state = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "unexpected")
    same = F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.n_bytes").eqNullSafe(F.col("b.n_bytes")) & F.col("a.media_type").eqNullSafe(F.col("b.media_type"))
    return joined.select(*keys, state.when(~same, "different").alias("state")).where("state is not null")
