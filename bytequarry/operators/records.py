"""Relations of a record machine: operands, references, opcode coverage, limits.

Instructions are rows (prototype, pc, raw_opcode, word_a, word_n, word_q).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.tables import dealt

CHANNELS = ("a", "n", "q")


def opcode_dimension(spark: SparkSession) -> DataFrame:
    """(raw_opcode, name, kind, target, status): the known opcodes; the list is fixed, so it is always broadcast."""
    rows = [(*o, "proven") for o in fixed.OPCODES] + [(o, None, None, None, "protocol") for o in fixed.PROTOCOL_OPCODES]
    lit = lambda v: F.lit(v) if v is not None else F.lit(None).cast("string")
    structs = F.array(*(F.struct(F.lit(o).alias("raw_opcode"), lit(n).alias("name"), lit(k).alias("kind"), lit(t).alias("target"), F.lit(s).alias("status")) for o, n, k, t, s in rows))
    return spark.range(1).select(F.explode(structs).alias("o")).select("o.*")


def operands(instructions: DataFrame) -> DataFrame:
    """(prototype, pc, raw_opcode, channel, mode, payload): one row a channel, without a shuffle."""
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"word_{c}").alias("word")) for c in CHANNELS))
    rows = instructions.select("prototype", "pc", "raw_opcode", F.explode(rows).alias("o"))
    return rows.select("prototype", "pc", "raw_opcode", "o.channel", (F.col("o.word") % 8).alias("mode"), F.floor(F.col("o.word") / 8).alias("payload"))


def resolve(operands: DataFrame) -> DataFrame:
    """Operands with constant_index, child_index or resolved, as the addressing mode says: 2, 4, 3 (ahead), 6 (back), else the payload."""
    mode, payload = F.col("mode"), F.col("payload")
    return operands.withColumns({
        "constant_index": F.when(mode == 2, payload),
        "child_index": F.when(mode == 4, payload),
        "resolved": F.when(mode == 3, F.col("pc") + payload).when(mode == 6, F.col("pc") - payload).when(~mode.isin(2, 4), payload),
    })


def mode_statistics(operands: DataFrame) -> DataFrame:
    return operands.groupBy("channel", "mode").agg(F.count("*").alias("n"), F.sum("payload").alias("payload_sum"), F.min("payload").alias("payload_min"), F.max("payload").alias("payload_max"))


def references(resolved: DataFrame, constants: DataFrame, prototypes: DataFrame, rows: int = 0) -> DataFrame:
    """(kind, prototype, pc, channel, index, found, is_string): references to constants and child prototypes.

    constants: (constant_index, is_string); prototypes: (child_index). Both are
    relations of the corpus and are joined by key; Spark broadcasts them if small.
    rows: about how many instructions there are, so that references are dealt out over enough tasks.
    """
    to_constant = dealt(resolved.where("constant_index is not null"), "constant_index", rows).join(constants.withColumn("found", F.lit(True)), "constant_index", "left")
    to_child = dealt(resolved.where("child_index is not null"), "child_index", rows).join(prototypes.distinct().withColumn("found", F.lit(True)), "child_index", "left")
    found = F.coalesce("found", F.lit(False))
    a = to_constant.select(F.lit("constant").alias("kind"), "prototype", "pc", "channel", F.col("constant_index").alias("index"), found.alias("found"), F.coalesce("is_string", F.lit(False)).alias("is_string"))
    return a.union(to_child.select(F.lit("prototype"), "prototype", "pc", "channel", "child_index", found, F.lit(False)))


def reference_statistics(refs: DataFrame) -> DataFrame:
    return refs.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("is_string").alias("strings"), F.count_if("found").alias("resolved"), F.count_if(~F.col("found")).alias("unresolved"))


def structural_coherence(instructions: DataFrame, refs: DataFrame, section: Column, root: Column) -> DataFrame:
    """(section, prototypes, instructions, unresolved_constants, unresolved_prototypes, root, coherent).

    A section that was read in step has a prototype and an instruction, no
    reference that points outside its pool, and a root among its prototypes,
    counted from 1. ``section`` is an expression of prototype, ``root`` of
    section. One shuffle, after partial sums.
    """
    none = F.lit(None)
    rows = instructions.select(section.alias("section"), "prototype", none.cast("string").alias("kind"))
    rows = rows.union(refs.where(~F.col("found")).select(section, none.cast("long"), "kind"))
    out = rows.groupBy("section").agg(
        F.count_distinct("prototype").alias("prototypes"), F.count("prototype").alias("instructions"),
        F.count_if(F.col("kind") == "constant").alias("unresolved_constants"), F.count_if(F.col("kind") == "prototype").alias("unresolved_prototypes"),
    )
    good = (F.col("instructions") > 0) & (F.col("unresolved_constants") == 0) & (F.col("unresolved_prototypes") == 0) & F.col("root").between(F.lit(1), F.col("prototypes"))
    return out.withColumn("root", root.cast("long")).withColumn("coherent", good)


def plausible(instructions: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Instructions of known opcodes (or all, the others with nulls) with largest_register, ceiling and plausible.

    A register comes from an operand of the register mode, plus a small offset at
    most; an effect that names a larger one was misread. Without such an operand
    no effect is plausible. One projection, no shuffle.
    """
    # With a branch for each opcode the generated method is too long for Java to compile; most formulas are the largest of some operands, and a number.
    uses: dict[str, list[int]] = {c: [] for c in CHANNELS}
    plus: dict[str, list[int]] = {}
    other: dict[str, list[int]] = {}
    for o, e in fixed.LARGEST_REGISTER.items():
        if m := re.fullmatch(r"(?:greatest\(([anq, ]+)\)|([anq]))(?: \+ (\d))?", e):
            for c in re.findall(r"\w", m[1] or m[2]):
                uses[c].append(o)
            plus.setdefault(m[3] or "0", []).append(o)
        else:
            other.setdefault(e, []).append(o)
    cases = lambda branches: " ".join(f"when raw_opcode in ({', '.join(map(str, opcodes))}) then {e}" for e, opcodes in branches.items())
    among = ", ".join(f"case {cases({c: opcodes})} end" for c, opcodes in uses.items())
    case = f"case {cases(other)} else greatest({among}) + case {cases(plus)} end end"
    payloads = instructions.withColumns({c: F.shiftright(F.col(f"word_{c}").cast("long"), 3) for c in CHANNELS})
    registers = [F.when(F.col(f"word_{c}") % 8 == fixed.REGISTER_MODE, F.col(c)).otherwise(-1) for c in CHANNELS]
    out = payloads.withColumns({"largest_register": F.expr(case).cast("long"), "ceiling": F.greatest(*registers)})
    out = out if keep_unknown else out.where("largest_register is not null")
    fits = (F.col("ceiling") >= 0) & (F.col("largest_register") <= F.col("ceiling") + fixed.REGISTER_SLACK)
    return out.withColumn("plausible", fits.cast("int")).drop(*CHANNELS)


def histogram(instructions: DataFrame) -> DataFrame:
    return instructions.groupBy("raw_opcode").agg(F.count("*").alias("n"))


def top_opcodes(instructions: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent opcodes of each prototype, smaller ones first among equals."""
    counted = instructions.groupBy("prototype", "raw_opcode").agg(F.count("*").alias("n"))
    order = Window.partitionBy("prototype").orderBy(F.col("n").desc(), "raw_opcode")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coverage(instructions: DataFrame, section: Column) -> DataFrame:
    """Proven, protocol and unresolved instructions of each section and (null section) of all, with ratios.

    The three parts always add up to the total; ``partition_ok`` says so.
    """
    spark = instructions.sparkSession
    known = instructions.withColumn("section", section).join(F.broadcast(opcode_dimension(spark).select("raw_opcode", "status")), "raw_opcode", "left")
    out = known.rollup("section").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "proven").alias("proven"), F.count_if(F.col("status") == "protocol").alias("protocol"),
        F.count_if(F.col("status").isNull()).alias("unresolved"), F.count_distinct("prototype").alias("prototypes"),
    )
    most = F.greatest(F.lit(1), F.col("total"))
    return out.select(
        "section", "total", "proven", "protocol", "unresolved", "prototypes", F.round(F.col("proven") / most, 6).alias("proven_ratio"),
        F.round((F.col("proven") + F.col("protocol")) / most, 6).alias("explained_ratio"), (F.col("proven") + F.col("protocol") + F.col("unresolved") == F.col("total")).cast("int").alias("partition_ok"),
    )


def unknown_opcodes(instructions: DataFrame) -> DataFrame:
    """Opcodes outside the dimension, with how often and in how many prototypes they occur."""
    unknown = instructions.join(F.broadcast(opcode_dimension(instructions.sparkSession).select("raw_opcode")), "raw_opcode", "left_anti")
    return unknown.groupBy("raw_opcode").agg(F.count("*").alias("n"), F.count_distinct("prototype").alias("prototypes"))


def calls(instructions: DataFrame, opcode: int = 62) -> DataFrame:
    """Generic calls: base register, arguments (-1: up to the top) and results (-1: all)."""
    n, q = (F.floor(F.col(f"word_{c}") / 8) for c in ("n", "q"))
    return instructions.where(F.col("raw_opcode") == opcode).select(
        "prototype", "pc", F.floor(F.col("word_a") / 8).alias("base"), F.when(n == 0, -1).otherwise(n - 1).alias("arguments"), F.when(q == 0, -1).otherwise(q - 1).alias("results"),
    )


def largest(instructions: DataFrame, k: int = 12) -> DataFrame:
    """The k longest prototypes, smaller numbers first among equals: a top-k that keeps k rows a task."""
    return instructions.groupBy("prototype").agg(F.count("*").alias("instructions")).orderBy(F.col("instructions").desc(), "prototype").limit(k)


def excerpt(instructions: DataFrame, head: int, tail: int) -> DataFrame:
    """The first and last instructions of each prototype; those between are counted in ``omitted``."""
    size = instructions.groupBy("prototype").agg(F.max("pc").alias("size"))
    rows = instructions.join(size, "prototype").where((F.col("pc") <= head) | (F.col("pc") > F.col("size") - tail))
    return rows.select("prototype", "pc", "raw_opcode", F.greatest(F.lit(0), F.col("size") - head - tail).alias("omitted"))


def captures(encoded: DataFrame, col: str) -> DataFrame:
    """Encoded captures with kind (the low two bits) and source_index."""
    return encoded.withColumns({"kind": F.col(col) % 4, "source_index": F.floor(F.col(col) / 4)})


def running_totals(sizes: DataFrame, limit: int, group: str = "section") -> DataFrame:
    """(section, prototype, instructions, running, within): running totals in order against a limit, within each section."""
    order = Window.partitionBy(group).orderBy("prototype").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("running", F.sum("instructions").over(order)).withColumn("within", (F.col("running") <= limit).cast("int"))


def opcode_coverage(instructions: DataFrame, section: Column, selector: Column) -> DataFrame:
    """(section, status, raw_opcode, n, micro): how often each opcode is proven, protocol or unresolved in a section.

    Opcodes have their meaning at selector 0 only; at others all are unresolved. micro counts unresolved instructions
    that keep state. Counts are summed before they move, and a section has as many rows as opcodes.
    """
    known = opcode_dimension(instructions.sparkSession).select("raw_opcode", F.col("status").alias("_status"))
    rows = instructions.select(section.alias("section"), selector.alias("selector"), "raw_opcode").join(F.broadcast(known), "raw_opcode", "left")
    status = F.when((F.col("selector") == 0) & F.col("_status").isNotNull(), F.col("_status")).otherwise("unresolved")
    counted = rows.select("section", status.alias("status"), "raw_opcode").groupBy("section", "status", "raw_opcode").agg(F.count("*").alias("n"))
    return counted.withColumn("micro", F.when((F.col("status") == "unresolved") & F.col("raw_opcode").isin(fixed.MICRO_OPCODES), F.col("n")).otherwise(F.lit(0)))


def coverage_manifest(opcodes: DataFrame) -> DataFrame:
    """(section, total, proven, protocol, unresolved, micro, proven_ratio, explained_ratio, *_opcodes) of each section and (null) of all.

    The last three are JSON objects of counts by opcode, in order of opcodes.
    """
    both = opcodes.unionByName(opcodes.groupBy("status", "raw_opcode").agg(F.sum("n").alias("n"), F.sum("micro").alias("micro")).withColumn("section", F.lit(None).cast(opcodes.schema["section"].dataType)))
    of = lambda s, c="n": F.coalesce(F.sum(F.when(F.col("status") == s, F.col(c))), F.lit(0))
    pairs = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("raw_opcode", "n"))))
    kinds = ("proven", "protocol", "unresolved")
    rows = both.groupBy("section").agg(F.sum("n").alias("total"), *(of(k).alias(k) for k in kinds), F.sum("micro").alias("micro"), *(pairs(k).alias(f"{k}_opcodes") for k in kinds))
    entry = lambda p: F.concat(F.lit('"'), p["raw_opcode"].cast("string"), F.lit('":'), p["n"].cast("string"))
    as_json = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(c, entry), ","), F.lit("}")).alias(c)
    ratios = [F.round(F.col("proven") / F.col("total"), 6).alias("proven_ratio"), F.round((F.col("proven") + F.col("protocol")) / F.col("total"), 6).alias("explained_ratio")]
    return rows.select("section", "total", *kinds, "micro", *ratios, *(as_json(f"{k}_opcodes") for k in kinds))


def live_coverage(instructions: DataFrame, blocks: DataFrame, reached: DataFrame) -> DataFrame:
    """(prototype, total, reachable, proven, protocol, unresolved, proven_ratio, explained_ratio) over instructions of reached blocks.

    Reached blocks become their places, so that instructions are joined by key, once. Ratios are of what is reached, or of all
    instructions of a prototype of which nothing is.
    """
    places = blocks.join(reached.select("prototype", "block_start"), ["prototype", "block_start"]).select("prototype", F.explode(F.sequence("block_start", "block_end")).alias("pc"), F.lit(1).alias("live"))
    known = opcode_dimension(instructions.sparkSession).select("raw_opcode", "status")
    rows = instructions.select("prototype", "pc", "raw_opcode").join(F.broadcast(known), "raw_opcode", "left").join(places, ["prototype", "pc"], "left")
    live = F.col("live") == 1
    out = rows.groupBy("prototype").agg(
        F.count("*").alias("total"), F.count_if(live).alias("reachable"), F.count_if(live & (F.col("status") == "proven")).alias("proven"),
        F.count_if(live & (F.col("status") == "protocol")).alias("protocol"), F.count_if(live & F.col("status").isNull()).alias("unresolved"),
    )
    least = F.when(F.col("reachable") == 0, F.col("total")).otherwise(F.col("reachable"))
    return out.select("*", F.round(F.col("proven") / least, 6).alias("proven_ratio"), F.round((F.col("proven") + F.col("protocol")) / least, 6).alias("explained_ratio"))


def runs_of(instructions: DataFrame, opcodes: list[int]) -> DataFrame:
    """(prototype, pc): places at which the given opcodes follow each other; one window over a prototype's rows."""
    order = Window.partitionBy("prototype").orderBy("pc")
    columns = [F.col("raw_opcode") if k == 0 else F.lead("raw_opcode", k).over(order) for k in range(len(opcodes))]
    rows = instructions.select("prototype", "pc", *(c.alias(f"_{k}") for k, c in enumerate(columns)))
    for k, o in enumerate(opcodes):
        rows = rows.where(F.col(f"_{k}") == o)
    return rows.select("prototype", "pc")


def root_first(prototypes: DataFrame, root: Column) -> DataFrame:
    """Prototypes (section, prototype) with place: the root first, then in order of numbers, from 1 within each section."""
    order = Window.partitionBy("section").orderBy(F.col("root").desc(), "prototype")
    return prototypes.withColumn("root", root.cast("int")).withColumn("place", F.row_number().over(order).cast("long"))


def coherent(sections: DataFrame) -> DataFrame:
    """Sections (prototypes, instructions, unresolved, root) that make sense: not empty, no reference unresolved, the root among the prototypes."""
    return sections.where((F.col("prototypes") > 0) & (F.col("instructions") > 0) & (F.col("unresolved") == 0) & F.col("root").between(1, F.col("prototypes")))


def broken_invariants(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, want, got): expected values (name, value) that the observed ones lack or contradict."""
    rows = expected.select("name", F.col("value").alias("want")).join(observed.select("name", F.col("value").alias("got")), "name", "left")
    return rows.where(~F.col("want").eqNullSafe(F.col("got")))
