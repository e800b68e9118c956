"""Bytecode words: instruction fields, range checks and variable-length numbers, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def fields(words: DataFrame, col: str = "word") -> DataFrame:
    """32-bit words with opcode, name, a, b, c, bx, sbx and format; name is null outside the opcode list."""
    cut = lambda shift, bits: F.shiftrightunsigned(F.col(col), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    out = words.withColumns({"opcode": cut(0, 6), "a": cut(6, 8), "c": cut(14, 9), "b": cut(23, 9), "bx": cut(14, 18)})
    names = F.array(*(F.lit(n) for n in fixed.LUA51))
    kind = F.when(F.col("opcode").isin(fixed.LUA51_ABX), "iABx").when(F.col("opcode").isin(fixed.LUA51_ASBX), "iAsBx").otherwise("iABC")
    return out.withColumns({"sbx": F.col("bx") - 131071, "name": F.get(names, F.col("opcode").cast("int")), "format": kind})


def branch_targets(fields: DataFrame, pc: Column) -> DataFrame:
    """JMP, FORLOOP and FORPREP with the place they go to."""
    return fields.where(F.col("opcode").isin(fixed.LUA51_ASBX)).withColumn("target", pc + 1 + F.col("sbx"))


def uleb_bytes(value: Column) -> Column:
    """The little-endian groups of seven bits of a number below 2**53, with continuation bits, as an array of ints."""
    groups = F.array(*(F.shiftrightunsigned(value, 7 * k).bitwiseAND(F.lit(127).cast("long")).cast("int") for k in range(8)))
    used = F.greatest(F.lit(1), *(F.when(F.shiftrightunsigned(value, 7 * k) > 0, k + 1).otherwise(1) for k in range(8)))
    return F.transform(F.slice(groups, 1, used), lambda b, k: F.when(k + 1 < used, b + 128).otherwise(b))


def uleb_value(groups: Column) -> Column:
    """The number that such bytes stand for."""
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m"))
    step = lambda s, b: F.struct((s["v"] + (b % 128).cast("long") * s["m"]).alias("v"), F.when(s["m"] < (1 << 49), s["m"] * 128).otherwise(s["m"]).alias("m"))
    return F.aggregate(groups, start, step, lambda s: s["v"])
