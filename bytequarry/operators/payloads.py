"""Predicates over decoded payloads: what their first bytes and their text say, and which are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import count


def payload_facts(payloads: DataFrame) -> DataFrame:
    """(artifact_id, n_bytes, lua51, raw_lzma, media_type, head) of payloads (artifact_id, content).

    Lua 5.1 chunks have the signature and their version's byte, raw range-coded
    streams start with zero. A payload is text if it is UTF-8 and more than a
    fixed share of it is printable; a byte order mark isn't counted, and signs
    beyond the first plane take two places. head shows the first bytes as hex.
    Null content is empty, which is no text. One projection over the scan.
    """
    content = F.coalesce("content", F.lit(b""))
    text = F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")), "^\\ufeff", "")
    size = F.length(text)
    share = (size - count(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) / F.greatest(F.lit(1), size + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")))
    start = lambda n: F.hex(F.substring(content, 1, n))
    return payloads.select(
        "artifact_id", F.octet_length(content).cast("long").alias("n_bytes"), (start(5) == fixed.LUA51_SIGNATURE).alias("lua51"), (start(1) == "00").alias("raw_lzma"),
        F.when(share > fixed.PRINTABLE_SHARE, fixed.TEXT_MEDIA_TYPE).otherwise(fixed.BINARY_MEDIA_TYPE).alias("media_type"), F.lower(start(fixed.PREVIEW_BYTES)).alias("head"),
    )


def known_profiles(artifacts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Artifacts (with loader_sha256 and payload_sha256) whose two hashes are both pinned together; nulls never match.

    Pinned pairs are distinct hashes, so no key is hot on their side, and a semi
    join leaves artifacts as often as they are; Spark picks the way by size.
    """
    keys = ["loader_sha256", "payload_sha256"]
    return artifacts.join(pinned.select(*keys).distinct(), keys, "left_semi").select(*artifacts.columns)
