"""Views that give the operators their shapes over general tables.

The SQL of these views reads the same in Spark and DuckDB, so that a query and
its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from ..sources.files import from_text
from .tables import dealt

_APIS = [
    "loadstring", "load", "dofile", "require", "hookmetamethod", "hookfunction", "newcclosure", "getnamecallmethod", "getcallbackmember", "readfile",
    "writefile", "appendfile", "makefolder", "delfile", "syn.request", "game:HttpGet", "game.GetAsync", "game:PostAsync", "game:RequestAsync", "setclipboard",
    "getgenv", "getfenv", "setfenv", "identifyexecutor", "shared", "debug.getinfo", "decompile", "r:FireServer", "r:InvokeServer", "r.OnClientEvent",
]


def _api(key: str) -> str:
    return f"case ({key}) % 30 " + " ".join(f"when {k} then '{a}'" for k, a in enumerate(_APIS)) + " end"


_ID, _NL, _BS = "cast(doc_id as string)", "chr(10)", "chr(92)"
_AUDIT = f"""concat('-- LURAPH PAYLOAD x DEVIRTUALIZED REGISTER-LEVEL', {_NL}, '-- stack slots: 4; decoded instructions: ', cast(doc_id % 90 as string),
 '; reachable CFG instructions: ', cast(doc_id % 70 as string), {_NL}, '-- statically applied array patches: 1; unreachable PCs omitted: 2', {_NL},
 'local function f', {_ID}, '(a)', {_NL}, '::L1:: MOVE', {_NL}, '::L2:: MOVE goto L1', {_NL}, '::L3:: goto L2', {_NL}, '::L4:: goto L9', {_NL}, '::L5:: goto L', cast(doc_id % 7 as string), {_NL}, 'end', {_NL},
 'local function g', {_ID}, '(a)', {_NL}, '::L1:: MOVE', {_NL}, case when doc_id % 2 = 0 then '::L1:: VM_FRAGMENT' else '::L6:: goto L4' end, {_NL}, '::L7:: MOVE', {_NL}, '::L8:: goto L7', {_NL}, 'end', {_NL})"""

#: One program of each document: calls, comments and strings that must not count, escapes in and out of literals, URLs, by
#: turns what the classifier and the detectors look for, and the document's whole text as code, in a comment or in a string.
PROGRAMS = f"""
select doc_id as artifact_id, concat('f', {_ID}, case when doc_id % 3 = 0 then '.lua' when doc_id % 8 = 1 then '.luau' else '.txt' end) as file_name,
 concat(
  'local v', {_ID}, ' = ', {_api("doc_id")}, '(', cast(n_chars as string), ')', {_NL},
  '-- ', {_api("doc_id + 7")}, ' in a comment', {_NL},
  'local s = "', {_api("doc_id + 11")}, ' https://site', cast(doc_id % 40 as string), '.example/p/', {_ID}, '),"', {_NL},
  case when doc_id % 4 = 0 then concat('if v then return v else v = L', cast(doc_id % 9 as string), '_1 + A2_', {_ID}, ' end', {_NL}) else '' end,
  case when doc_id % 6 = 0 then concat('v += 1', {_NL}, 'x, y = a.b(...), function() end', {_NL}) else '' end,
  case when doc_id % 5 = 0 then {_AUDIT} else '' end,
  case when doc_id % 11 = 0 then concat('MoonSec V3 ', repeat('while n%0x19<0x10 do n=(n+0x1f)%0x1f9; end; ', 40), 's="', repeat(concat({_BS}, '123'), 120), '" getfenv()') else '' end,
  case when doc_id % 13 = 0 then repeat(chr(1), 50) else '' end,
  'w ', {_BS}, '"', {_api("doc_id + 3")}, '" z', {_NL}, 'e = ', chr(39), 'it', {_BS}, chr(39), 's ', {_api("doc_id + 5")}, {_BS}, {_BS}, chr(39), ' .. ', {_api("doc_id + 13")}, {_NL},
  'g = [=[ ', {_BS}, '" ]] ', {_api("doc_id + 9")}, {_NL}, ' ]=] --[[ ', {_api("doc_id + 2")}, {_NL}, ' ]] h = o', {_ID}, '.m(o', {_ID}, ', 1)', {_NL},
  case doc_id % 4 when 0 then concat('--[==[ ', coalesce(text, ''), {_NL}, ']==]') when 1 then concat('t = [[', coalesce(text, ''), ']] ', {_NL}) when 2 then concat('t = "', coalesce(text, ''), {_NL}) else coalesce(text, '') end, {_NL},
  case when doc_id % 17 = 0 then concat('-- protected using Luraph Obfuscator v14.7', {_NL}, 'local V,y=Y([=[LPH@Vabc]=]),Y([==[LPH!xyz]==])', {_NL}) else '' end
 ) as text
from documents
"""

_SAID = f"replace(replace(replace(replace(coalesce(text, ''), {_BS}, concat({_BS}, {_BS})), chr(34), concat({_BS}, chr(34))), chr(10), concat({_BS}, 'n')), chr(13), concat({_BS}, 'r'))"
#: Documents as tables of literals: clauses joined, a sentence an entry; by turns sentences in brackets with a literal behind, or a name behind that keeps them apart.
LITERALS = f"""
select doc_id as artifact_id, concat('local t = ', chr(123), case when doc_id % 3 = 1 then '(' else '' end, chr(34),
 replace(replace({_SAID}, ', ', concat(', ', chr(34), '..', chr(34))), '. ',
  concat('.', chr(34), case doc_id % 3 when 1 then ').."!",(' when 2 then '..x,' else ',' end, chr(34))),
 chr(34), case when doc_id % 3 = 1 then ').."!"' else '' end, chr(125)) as text
from documents
"""

_OPCODES = [*(o[0] for o in fixed.OPCODES), *fixed.PROTOCOL_OPCODES, *range(300, 312)]

#: Line items as instructions: an order is a prototype, a part a constant.
INSTRUCTIONS = f"""
select prototype, pc, l_partkey * 8 + l_linenumber % 8 as word_a, l_suppkey * 8 + cast(l_quantity as bigint) % 8 as word_n,
 (prototype % 97) * 8 + l_suppkey % 8 as word_q, case l_partkey % 100 {" ".join(f"when {k} then {o}" for k, o in enumerate(_OPCODES))} end as raw_opcode
from (
 select l_orderkey as prototype, l_partkey, l_suppkey, l_linenumber, l_quantity,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as bigint) as pc
 from lineitem) t
"""

#: Line items as Lua 5.1 words, many of them list assignments and closures, by place from 0 in their order.
WORDS = """
select prototype, pc, case when k < 3 then 34 + a * 64 + b * 8388608 when k = 3 then 36 + a * 64 + (b % 5) * 16384 when k = 4 then cast(22 + a * 64 as bigint) + (131071 + b % 9 - 4) * 16384
 else p % 40 + a * 64 + c * 16384 + b * 8388608 end as word
from (
 select l_orderkey as prototype, l_suppkey % 60 as a, (l_partkey * 7) % 300 as b, (l_partkey * 31) % 300 as c, l_partkey % 10 as k, l_partkey as p,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as bigint) as pc
 from lineitem) t
"""

#: Orders as the headers of Lua 5.1 prototypes.
PROTOTYPES = """
select prototype, max_stack, upvalues, n_constants, n_children, n_instructions, case when prototype % 3 = 0 then 0 when prototype % 3 = 1 then n_instructions else 5 end as n_lines, n_upvalue_names, chunk
from (
 select o_orderkey as prototype, 2 + o_custkey % 60 as max_stack, o_custkey % 3 as upvalues, o_orderkey % 40 as n_constants, o_orderkey % 4 as n_children, coalesce(n, 0) as n_instructions,
  o_orderkey % 5 as n_upvalue_names, o_custkey % 50 as chunk
 from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) c on l_orderkey = o_orderkey) t
"""


#: Documents as payloads: chunks of two versions, streams that start with zero, bytes that are no UTF-8, a mark, control bytes, nothing.
PAYLOADS = """
select doc_id as artifact_id, unhex(concat(
 case cast(doc_id % 8 as int) when 0 then '1B4C756151' when 1 then '1B4C756152' when 2 then '00' when 3 then 'FF' when 4 then 'EFBBBF' when 5 then 'F09F9880' else '' end,
 case when doc_id % 5 = 0 then repeat('01', cast(coalesce(n_chars, 0) % 60 as int)) else '' end,
 case when doc_id % 11 = 0 then '' else hex(coalesce(text, '')) end)) as content
from documents
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of few small numbers a row, and what is made of it: joins shuffle it, as its files look smaller than its rows are."""
    return _table(spark, sf_dir, name).hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return from_text(_table(spark, sf_dir, "documents"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), "text")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.sql(PROGRAMS.replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))
    return rows.withColumn("is_bytecode", F.lit(False))


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LITERALS.replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAYLOADS.replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))


def instructions(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """rows: about how many there are, so that those of a prototype are placed in enough tasks; only for those who use the places."""
    lineitem = dealt(_table(spark, sf_dir, "lineitem"), "l_orderkey", rows).hint("merge")
    return spark.sql(INSTRUCTIONS.replace("from lineitem", "from {lineitem}"), lineitem=lineitem)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORDS.replace("from lineitem", "from {lineitem}"), lineitem=_rows(spark, sf_dir, "lineitem"))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = PROTOTYPES.replace("from lineitem", "from {lineitem}").replace("from orders", "from {orders}")
    return spark.sql(text, lineitem=_rows(spark, sf_dir, "lineitem"), orders=_rows(spark, sf_dir, "orders")).hint("merge")


def parts_of(prototypes: DataFrame, count: str, *columns: str) -> DataFrame:
    """(prototype, index, ..): a prototype's numbered parts from 0, as many as the named column says.

    Joins shuffle it: Spark takes it for as small as the prototypes are.
    """
    rows = prototypes.where(f"{count} > 0").selectExpr("*", f"explode(sequence(0L, {count} - 1)) as index")
    return rows.selectExpr("prototype", "index", *columns).hint("merge")
