"""Comment and string regions with offsets, and offsets joined to lines.

Offsets are code points from 0, ends are exclusive. Texts become rows of lengths,
not of text; running sums and the as-of join go block by block, so that a task
sorts one block of a text at a time, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKENS
from ..plans.tables import written

#: Rows of one block of a running sum; places of a text that one block of the as-of join covers.
SUM_ROWS, SPAN = 1 << 14, 1 << 14


def running_sums(rows: DataFrame, key: str, at: str, value: str, out: str, rows_a_block: int = SUM_ROWS) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the key's rows of smaller ``at``, which counts from 0 without gaps.

    Blocks are summed first; a row's sum is its block's base plus what precedes it in the block.
    """
    rows = written(rows, "lengths")
    block = F.floor(F.col(at) / rows_a_block)
    sums = rows.groupBy(key, block.alias("_block")).agg(F.sum(value).alias("_sum"))
    before = lambda *k: Window.partitionBy(*k)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(before(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_block", block).withColumn("_inside", inside)
    return rows.join(base, [key, "_block"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_block", "_base", "_inside")


def _kind(token: Column) -> Column:
    return F.when(token.startswith("--"), F.lit("comment")).when(token.rlike(r"""^["']|^\[=*\["""), F.lit("string"))


def regions(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, kind, start, end) of every comment and string: an unclosed one ends with the text.

    Null and empty texts have none. Rows that repeat an artifact_id must not occur: offsets are sums over its tokens.
    """
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(TOKENS), F.lit(0))
    parts = F.transform(tokens, lambda t: F.struct(F.length(t).cast("long").alias("size"), _kind(t).alias("kind")))
    rows = sources.select("artifact_id", F.posexplode(parts).alias("at", "part")).select("artifact_id", "at", "part.size", "part.kind")
    rows = running_sums(rows, "artifact_id", "at", "size", "start").where("kind is not null")
    return rows.select("artifact_id", "kind", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))


def line_starts(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, line, start): where each line starts, lines from 1; every text has a first line, the empty one too."""
    sizes = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda t: (F.length(t) + 1).cast("long"))
    rows = sources.select("artifact_id", F.posexplode(sizes).alias("at", "size"))
    rows = running_sums(rows, "artifact_id", "at", "size", "start")
    return rows.select("artifact_id", (F.col("at") + 1).cast("long").alias("line"), F.col("start").cast("long").alias("start"))


def lines_of(offsets: DataFrame, starts: DataFrame, offset: str = "offset", span: int = SPAN) -> DataFrame:
    """``offsets`` (artifact_id, the offset and any other columns) with line: the last line that starts at or before the offset.

    An as-of join in blocks of ``span`` places: within a block the lines that
    start there decide, before the first of them the last line of an earlier
    block. Offsets beyond the text are on its last line, negative or null ones, or
    those of unknown artifacts, on none.
    """
    block = lambda c: F.floor(F.col(c) / span).alias("_block")
    columns = offsets.columns
    place = F.struct(*(F.col(c) for c in columns)).alias("_row")
    asked = offsets.select("artifact_id", block(offset), F.col(offset).cast("long").alias("_at"), F.lit(None).cast("long").alias("_line"), place)
    known = starts.select("artifact_id", block("start"), F.col("start").alias("_at"), F.col("line").alias("_line"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy("artifact_id", "_block").orderBy("_at", F.col("_line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = known.union(asked).withColumn("_line", F.max("_line").over(order)).where("_row is not null")
    # The last line before each block in which something is asked or starts; one row a block.
    lasts = known.groupBy("artifact_id", "_block").agg(F.max("_line").alias("_last")).union(asked.where("_at >= 0").select("artifact_id", "_block", F.lit(None).cast("long")).distinct())
    lasts = lasts.groupBy("artifact_id", "_block").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("artifact_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("_last", F.max("_last").over(before))
    out = met.join(lasts, ["artifact_id", "_block"], "left")
    return out.select(*(F.col("_row")[c].alias(c) for c in columns), F.when(F.col("_at") >= 0, F.coalesce("_line", "_last")).alias("line"))


def regions_with_lines(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """(artifact_id, kind, start, end, first_line, last_line): regions and the lines on which their first and last signs stand."""
    starts = line_starts(sources, text_col)
    found = regions(sources, text_col)
    found = lines_of(found, starts, "start").withColumnRenamed("line", "first_line").withColumn("_last", F.col("end") - 1)
    return lines_of(found, starts, "_last").withColumnRenamed("line", "last_line").drop("_last")
