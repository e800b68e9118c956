"""Checks of Lua 5.1 prototypes, as joins and filters over their instructions.

Instructions are rows (prototype, pc, word), pc from 0 without gaps; prototypes
(prototype, max_stack, upvalues, n_constants, n_children, n_instructions, n_lines,
n_upvalue_names); constants (prototype, index, is_string); children (prototype,
index, upvalues); variables (prototype, index, name, start_pc, end_pc). Rows of a
prototype that isn't among the prototypes are left out. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import dealt
from . import chunk

_RK = ("SETTABLE", "ADD", "SUB", "MUL", "DIV", "MOD", "POW", "EQ", "LT", "LE")
#: Which operands of which opcodes are registers, registers or constants, or upvalues.
REGISTER_B = ("MOVE", "LOADNIL", "UNM", "NOT", "LEN", "TESTSET", "GETTABLE", "SELF", "CONCAT")
REGISTER_C = ("CONCAT",)
RK_B, RK_C = _RK, (*_RK, "GETTABLE", "SELF")
UPVALUE_B = ("GETUPVAL", "SETUPVAL")
NO_REGISTER_A = ("JMP", "EQ", "LT", "LE")


def decoded(instructions: DataFrame) -> DataFrame:
    """Fields of the words, with is_data: words that belong to a list assignment before them.

    A list assignment with C = 0 takes the next word along, whatever it looks like.
    In a run of such words every second one is therefore data: its place in the run
    decides, so one window over a prototype's words is enough.
    """
    rows = chunk.fields(instructions)
    order = Window.partitionBy("prototype").orderBy("pc")
    takes = (F.col("name") == "SETLIST") & (F.col("c") == 0)
    rows = rows.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    rows = rows.withColumn("_other", F.last(F.when(~F.col("_takes"), F.col("pc")), ignorenulls=True).over(order))
    place = F.col("pc") - F.coalesce("_other", F.lit(-1))
    before = F.lag(F.when(F.col("_takes") & (place % 2 == 1), 1)).over(order)
    return rows.withColumn("is_data", before.isNotNull()).drop("_takes", "_other")


def bindings(decoded: DataFrame, children: DataFrame) -> DataFrame:
    """(prototype, owner_pc, child, upvalue, pc): the words after a closure that bind its upvalues, also past the code's end."""
    owners = decoded.where((F.col("name") == "CLOSURE") & ~F.col("is_data")).select("prototype", F.col("pc").alias("owner_pc"), F.col("bx").alias("child"))
    children = children.where("upvalues > 0").select("prototype", F.col("index").alias("child"), "upvalues")
    rows = owners.join(children, ["prototype", "child"]).select("prototype", "owner_pc", "child", F.explode(F.sequence(F.lit(0), F.col("upvalues").cast("int") - 1)).alias("upvalue"))
    return rows.select("prototype", "owner_pc", "child", F.col("upvalue").cast("long").alias("upvalue"), (F.col("owner_pc") + 1 + F.col("upvalue")).alias("pc"))


def _found(rows: DataFrame, checks: list[tuple[Column, str, str]], *more: str) -> DataFrame:
    """(prototype, pc, code, operand) and other columns: a row for each check that holds; checks are evaluated in one projection."""
    hit = lambda cond, code, operand: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(operand).alias("operand")))
    rows = rows.select("prototype", "pc", *more, F.explode(F.array_compact(F.array(*(hit(*c) for c in checks)))).alias("d"))
    return rows.select("prototype", "pc", *more, "d.code", "d.operand")


def words(decoded: DataFrame, prototypes: DataFrame, *more: str) -> DataFrame:
    """What each word alone shows against its prototype's header, with more of the word's columns if asked: one join on the prototype."""
    rows = decoded.where(~F.col("is_data")).join(prototypes, "prototype")
    name, a, b, c, bx = (F.col(x) for x in ("name", "a", "b", "c", "bx"))
    beyond = lambda r: r >= F.col("max_stack")
    of = lambda names: F.coalesce(name.isin(*names), F.lit(False))
    checks = [(name.isNull(), "LUA51_INVALID_OPCODE", "opcode"), (name.isNotNull() & ~of(NO_REGISTER_A) & beyond(a), "LUA51_REGISTER_OUT_OF_RANGE", "A")]
    for x, registers, either in ((b, REGISTER_B, RK_B), (c, REGISTER_C, RK_C)):
        operand = "B" if x is b else "C"
        checks += [
            (((of(registers) | (of(either) & (x < 256))) & beyond(x)), "LUA51_REGISTER_OUT_OF_RANGE", operand),
            ((of(either) & (x >= 256) & (x - 256 >= F.col("n_constants"))), "LUA51_CONSTANT_OUT_OF_RANGE", operand),
        ]
    target = F.col("pc") + 1 + F.col("sbx")
    jumps = F.col("format") == "iAsBx"
    checks += [
        (of(UPVALUE_B) & (b >= F.col("upvalues")), "LUA51_UPVALUE_OUT_OF_RANGE", "B"),
        (of(["CONCAT"]) & (b > c), "LUA51_INVALID_CONCAT_RANGE", "B..C"),
        (of(["LOADNIL"]) & (a > b), "LUA51_INVALID_LOADNIL_RANGE", "A..B"),
        (of(["SELF"]) & beyond(a + 1), "LUA51_REGISTER_OUT_OF_RANGE", "A+1"),
        (of(["FORLOOP", "FORPREP"]) & beyond(a + 3), "LUA51_REGISTER_OUT_OF_RANGE", "A+3"),
        (of(["TFORLOOP"]) & beyond(a + 2 + c), "LUA51_REGISTER_OUT_OF_RANGE", "A+2+C"),
        (of(["LOADK", "GETGLOBAL", "SETGLOBAL"]) & (bx >= F.col("n_constants")), "LUA51_CONSTANT_OUT_OF_RANGE", "Bx"),
        (jumps & ((target < 0) | (target >= F.col("n_instructions"))), "LUA51_BRANCH_OUT_OF_RANGE", "sBx"),
        (of(["SETLIST"]) & (c == 0) & (F.col("pc") + 1 >= F.col("n_instructions")), "LUA51_MISSING_SETLIST_EXTRA", "C"),
        (of(["CLOSURE"]) & (bx >= F.col("n_children")), "LUA51_PROTOTYPE_OUT_OF_RANGE", "Bx"),
    ]
    return _found(rows, checks, *more)


def links(decoded: DataFrame, prototypes: DataFrame, constants: DataFrame, children: DataFrame) -> DataFrame:
    """What only other rows show: names of globals, targets of branches, words that bind upvalues; joins by key."""
    real = decoded.where(~F.col("is_data"))
    real = real.join(prototypes.select("prototype"), "prototype", "left_semi")
    named = real.where(F.col("name").isin("GETGLOBAL", "SETGLOBAL")).select("prototype", "pc", F.col("bx").alias("index"))
    other = named.join(constants.where(~F.col("is_string")).select("prototype", "index"), ["prototype", "index"], "left_semi")
    jumps = real.where(F.col("format") == "iAsBx").select("prototype", F.col("pc").alias("at"), (F.col("pc") + 1 + F.col("sbx")).alias("pc"))
    into = jumps.join(decoded.where("is_data").select("prototype", "pc"), ["prototype", "pc"], "left_semi").select("prototype", F.col("at").alias("pc"))
    row = lambda rows, code, operand: rows.select("prototype", "pc", F.lit(code).alias("code"), F.lit(operand).alias("operand"))
    out = row(other, "LUA51_GLOBAL_NAME_NOT_STRING", "Bx").union(row(into, "LUA51_BRANCH_TO_DATA_WORD", "sBx"))
    bound = bindings(decoded, children).join(prototypes.select("prototype", "max_stack", F.col("upvalues").alias("own"), "n_instructions"), "prototype")
    bound = bound.join(decoded.select("prototype", "pc", "name", "b", "is_data", F.lit(True).alias("there")), ["prototype", "pc"], "left")
    name, data = F.col("name"), F.col("is_data")
    gone = F.col("there").isNull() & (F.col("pc") == F.col("n_instructions"))
    missing = bound.where(gone).select("prototype", F.col("owner_pc").alias("pc"))
    checks = [
        (data | ~F.coalesce(name.isin("MOVE", "GETUPVAL"), F.lit(False)), "LUA51_INVALID_CLOSURE_BINDING", "pc"),
        (~data & (name == "MOVE") & (F.col("b") >= F.col("max_stack")), "LUA51_REGISTER_OUT_OF_RANGE", "B"),
        (~data & (name == "GETUPVAL") & (F.col("b") >= F.col("own")), "LUA51_UPVALUE_OUT_OF_RANGE", "B"),
    ]
    return out.union(row(missing, "LUA51_MISSING_CLOSURE_BINDING", "pc")).union(_found(bound.where("there"), checks))


def headers(prototypes: DataFrame, variables: DataFrame, upvalue_names: DataFrame, rows: int = 0) -> DataFrame:
    """Debug information that doesn't fit the code: (prototype, pc null, code, operand). upvalue_names: (prototype, index, name).

    rows: about how many variables there are, so that they meet their prototypes in enough tasks. Names move only if they are null.
    """
    n, lines, names = F.col("n_instructions"), F.col("n_lines"), F.col("n_upvalue_names")
    own = prototypes.withColumn("pc", F.lit(None).cast("long"))
    out = _found(own, [((lines != 0) & (lines != n), "LUA51_DEBUG_LINE_COUNT_MISMATCH", "lines"), ((names != 0) & (names != F.col("upvalues")), "LUA51_DEBUG_UPVALUE_COUNT_MISMATCH", "upvalues")])
    local = dealt(variables.select("prototype", "name", "start_pc", "end_pc"), "prototype", rows).join(dealt(own.select("prototype", "pc", "n_instructions"), "prototype", rows), "prototype")
    start, end = F.col("start_pc"), F.col("end_pc")
    out = out.union(_found(local, [(F.col("name").isNull(), "LUA51_NULL_LOCAL_NAME", "local"), ((start < 0) | (end < start) | (end > n), "LUA51_INVALID_LOCAL_RANGE", "local")]))
    unnamed = dealt(upvalue_names.where("name is null"), "prototype", rows).join(dealt(own.select("prototype", "pc"), "prototype", rows), "prototype")
    return out.union(_found(unnamed, [(F.col("name").isNull(), "LUA51_NULL_UPVALUE_NAME", "upvalue")]))


def declarations(prototypes: DataFrame, lines: DataFrame, strings: DataFrame) -> DataFrame:
    """(prototype, index, code, severity): what a prototype's header, its debug lines and its string constants show alone.

    prototypes: (prototype, max_stack, parameters, upvalues, vararg_flags,
    first_line, last_line); lines: (prototype, index, line); strings: (prototype,
    index, n_bytes), the encoded length. index is null for the header. Nulls fail no check. No shuffle.
    """
    n = F.col("max_stack")
    checks = [
        ((n < 1) | (n > 250), "LUA51_INVALID_MAX_STACK", "error"), (F.col("parameters") > n, "LUA51_PARAMETERS_EXCEED_STACK", "error"), (F.col("vararg_flags") > 7, "LUA51_INVALID_VARARG_FLAGS", "error"),
        (F.col("upvalues") > 60, "LUA51_NONCANONICAL_UPVALUE_COUNT", "warning"), ((F.col("first_line") < 0) | (F.col("last_line") < 0), "LUA51_NEGATIVE_SOURCE_LINE", "warning"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in checks)))
    out = prototypes.select("prototype", F.lit(None).cast("long").alias("index"), F.explode(found).alias("d")).select("prototype", "index", "d.code", "d.severity")
    row = lambda rows, code, level: rows.select("prototype", "index", F.lit(code).alias("code"), F.lit(level).alias("severity"))
    out = out.union(row(lines.where("line < 0"), "LUA51_NEGATIVE_DEBUG_LINE", "warning"))
    return out.union(row(strings.where("n_bytes = 0"), "LUA51_NULL_STRING_CONSTANT", "error"))


def severity(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with severity: debug counts that don't fit are warnings, all else is an error."""
    return diagnostics.withColumn("severity", F.when(F.col("code").startswith("LUA51_DEBUG_"), "warning").otherwise("error"))


def chunk_statistics(prototypes: DataFrame, constants: DataFrame, variables: DataFrame, key: str = "chunk") -> DataFrame:
    """(chunk, prototypes, instructions, lines, upvalue_names, constants, string_bytes, locals): sums over a chunk's tables, each summed before it is joined.

    prototypes carry the chunk; constants (chunk, n_bytes; null where no string), variables (chunk).
    """
    p = prototypes.groupBy(key).agg(F.count("*").alias("prototypes"), *(F.sum(c).alias(n) for c, n in (("n_instructions", "instructions"), ("n_lines", "lines"), ("n_upvalue_names", "upvalue_names"))))
    k = constants.groupBy(key).agg(F.count("*").alias("constants"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("string_bytes"))
    v = variables.groupBy(key).agg(F.count("*").alias("locals"))
    return p.join(k, key, "left").join(v, key, "left").fillna(0, ["constants", "string_bytes", "locals"])
