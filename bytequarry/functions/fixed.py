"""Fixed values that results depend on: patterns, weights, names and numbers.

Patterns use ASCII word boundaries; ``text.java`` writes them for Spark.
"""

from __future__ import annotations

# Capability specs (category, api, pattern), matched on masked code.
CAPABILITIES = [
    ("dynamic-code", "loadstring", r"\bloadstring\b"),
    ("dynamic-code", "load", r"\bload\b"),
    ("dynamic-code", "dofile", r"\bdofile\b"),
    ("dynamic-code", "require", r"\brequire\b"),
    ("executor-hook", "hookmetamethod", r"\bhookmetamethod\b"),
    ("executor-hook", "hookfunction", r"\bhookfunction\b"),
    ("executor-hook", "newcclosure", r"\bnewcclosure\b"),
    ("executor-hook", "getnamecallmethod", r"\bgetnamecallmethod\b"),
    ("executor-hook", "getcallbackmember", r"\bgetcallbackmember\b"),
    ("filesystem", "readfile", r"\breadfile\b"),
    ("filesystem", "writefile", r"\bwritefile\b"),
    ("filesystem", "appendfile", r"\bappendfile\b"),
    ("filesystem", "makefolder", r"\bmakefolder\b"),
    ("filesystem", "delfile", r"\bdelfile\b"),
    ("network", "request", r"\b(?:request|http_request)\b|\bsyn\s*\.\s*request\b"),
    ("network", "HttpGet", r"(?:[:.]\s*HttpGet\b|\bHttpGet\b)"),
    ("network", "GetAsync", r"(?:[:.]\s*GetAsync\b|\bGetAsync\b)"),
    ("network", "PostAsync", r"(?:[:.]\s*PostAsync\b|\bPostAsync\b)"),
    ("network", "RequestAsync", r"(?:[:.]\s*RequestAsync\b|\bRequestAsync\b)"),
    ("clipboard", "setclipboard", r"\bsetclipboard\b"),
    ("environment", "getgenv", r"\bgetgenv\b"),
    ("environment", "getfenv", r"\bgetfenv\b"),
    ("environment", "setfenv", r"\bsetfenv\b"),
    ("environment", "identifyexecutor", r"\bidentifyexecutor\b"),
    ("environment", "shared", r"\bshared\b"),
    ("debug-introspection", "debug/getinfo", r"\bdebug\s*\.\s*getinfo\b|\bgetinfo\b"),
    ("debug-introspection", "decompile/disassemble", r"\b(?:decompile|disassemble)\b"),
    ("roblox-remote", "FireServer", r"[:.]\s*FireServer\b"),
    ("roblox-remote", "InvokeServer", r"[:.]\s*InvokeServer\b"),
    ("roblox-remote", "OnClientEvent/OnClientInvoke", r"\b(?:OnClientEvent|OnClientInvoke)\b"),
]
CAPABILITY_LINES = 25
URL = r"(?i)\bhttps?://[^\s\"'`<>{}\[\]]+"
URL_CHARS = 2048

# Hazard probes on masked code. The last has a back-reference.
HAZARDS = [
    ("stored-call", r"=\s*[A-Za-z_(][^\n;=]*\([^;\n]*\)"),
    ("stored-vararg", r"=\s*\.\.\."),
    ("member-index", r"=\s*[A-Za-z_(][^\n;]*(?:\.|\[)[^\n;]*"),
    ("arithmetic", r"=\s*[^\n;]+(?:\+|-|\*|/|%|#)[^\n;]*"),
    ("closure", r"\bfunction\b"),
    ("multiple-assignment", r"\b[A-Za-z_]\w*\s*,\s*[A-Za-z_]\w*\s*="),
    ("dot-self-call", r"\b([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\.\s*[A-Za-z_]\w*\s*\(\s*\1\b"),
]

# The same matches by patterns that look at a line once from each sign of equality: masked code has long runs of spaces, over
# which neighbouring repeats would be tried in all divisions.
LINEAR = {
    HAZARDS[0][1]: r"=\s*+[A-Za-z_(][^\n;=(]*+\([^;\n]*\)",
    HAZARDS[1][1]: r"=\s*+\.\.\.",
    HAZARDS[2][1]: r"=\s*+[A-Za-z_(][^\n;.\[]*+[.\[][^\n;]*+",
    HAZARDS[3][1]: r"=\s*+(?:[^\n;][^\n;*/%#+-]*+[*/%#+-]|(?<=[^\S\n])[*/%#+-])[^\n;]*+",
    HAZARDS[5][1]: r"\b[A-Za-z_]\w*+\s*+,\s*+[A-Za-z_]\w*+\s*+=",
}

# Classifier signals (name, pattern, least count).
AUDIT_SIGNALS = [
    ("register-level header", r"(?i)LURAPH PAYLOAD[\s\S]{0,80}DEVIRTUALIZED REGISTER-LEVEL", 1),
    ("decoded-instruction metadata", r"(?i)--\s*stack slots:\s*\d+;\s*decoded instructions:", 1),
    ("dense VM labels", r"::L\d+::", 8),
    ("VM goto graph", r"\bgoto\s+L\d+\b", 4),
    ("unresolved VM fragments", r"\bVM_FRAGMENT\b", 1),
    ("recovered prototype paths", r"(?i)--\s*source path:\s*root(?:\.M\[\d+\])*", 1),
]
LUAU_SIGNALS = [
    ("continue statement", r"\bcontinue\b"),
    ("compound assignment", r"(?:\+=|-=|\*=|/=|//=|\.\.=)"),
    ("type declaration", r"\bexport\s+type\b|\btype\s+[A-Za-z_]\w*\s*="),
    ("type annotation", r"(?:local\s+[A-Za-z_]\w*|function\s*\([^)]*)\s*:\s*[A-Za-z_{(]"),
    ("interpolated string", r"`(?:\\.|[^`])*`"),
    ("if-expression", r"=\s*if\b[^\n;]+\bthen\b[^\n;]+\belse\b"),
]
STATEMENTS = r"\b(?:local|function|return|if|then|end|for|while|repeat)\b"
LUA_SIGNATURE = "1B4C7561"
LUA51_SIGNATURE = "1B4C756151"
PRINTABLE_SHARE = 0.97
TEXT_MEDIA_TYPE = "text/x-lua; charset=utf-8"
BINARY_MEDIA_TYPE = "application/octet-stream"
PREVIEW_BYTES = 32
CONTROL_SHARE = 0.01

# Counts that the detectors look at (name, on masked code, pattern).
COUNTS = [
    ("wrapper_code", True, r"(?i)\bMoonSec(?:\s+V3)?\b"),
    ("wrapper_raw", False, r"(?i)\bMoonSec(?:\s+V3)?\b"),
    ("hex", True, r"(?i)\b0x[0-9a-f]+\b"),
    ("escapes", False, r"\\\d{1,3}"),
    ("loops", True, r"\bwhile\b[\s\S]{0,100}\bdo\b"),
    ("modulo", True, r"(?i)%\s*0x[0-9a-f]+"),
    ("environment", True, r"\b(?:getfenv|setfenv|_ENV)\b"),
    ("audit_header", False, r"(?i)LURAPH PAYLOAD[\s\S]{0,100}DEVIRTUALIZED REGISTER-LEVEL"),
    ("audit_name", False, r"(?i)\bLuraph\b"),
    ("labels", False, r"::L\d+::"),
    ("gotos", False, r"\bgoto\s+L\d+\b"),
    ("metadata", False, r"(?i)stack slots:\s*\d+;\s*decoded instructions:\s*\d+;\s*reachable CFG instructions:\s*\d+"),
    ("fragments", False, r"\bVM_FRAGMENT\b"),
    ("loader_header", False, r"(?i)protected\s+using\s+Luraph\s+Obfuscator\s+v14\.7"),
    ("loader_streams", False, r"local\s+V\s*,\s*y\s*=\s*Y\s*\(\s*\[=\[LPH@V[\s\S]*?\]=\]\s*\)\s*,\s*Y\s*\(\s*\[==\[LPH!"),
]
LOADER_LITERALS = ['i=a(i,"z","!!!!!"', 'y("<I4",k)', "Luraph decompression error"]
LOADER_NAME = r"(?i)^jnkie(?:[_-]payload)?\.(?:lua|luau|txt)$"
DENSE_CHARS, DENSE_LINES = 50_000, 3

# Evidence in order of addition (detector, id, SQL condition over the counts, weight).
BASES = {"generic-static": 0.18, "protected-loader": 0.0, "vm-audit": 0.01, "wrapper-family": 0.02}
EVIDENCE = [
    ("generic-static", "source-classification", "kind in ('lua-source', 'luau-source')", 0.62),
    ("generic-static", "bytecode-classification", "kind = 'lua-bytecode'", 0.7),
    ("generic-static", "family-ir", "kind = 'vm-audit-ir'", -0.15),
    ("generic-static", "non-lua-input", "kind in ('text', 'binary')", -0.25),
    ("wrapper-family", "code-marker", "wrapper_code > 0", 0.48),
    ("wrapper-family", "trivia-marker", "wrapper_code = 0 and wrapper_raw > 0", 0.2),
    ("wrapper-family", "dense-single-line-wrapper", f"n_chars >= {DENSE_CHARS} and n_lines <= {DENSE_LINES}", 0.14),
    ("wrapper-family", "hex-constant-density", "hex >= 100", 0.14),
    ("wrapper-family", "encoded-byte-string-density", "escapes >= 100", 0.16),
    ("wrapper-family", "opaque-state-machine", "loops >= 8 and modulo >= 30", 0.22),
    ("wrapper-family", "environment-recovery", "environment > 0", 0.06),
    ("wrapper-family", "negative-vm-audit", "kind = 'vm-audit-ir'", -0.45),
    ("vm-audit", "audit-header", "audit_header > 0", 0.4),
    ("vm-audit", "name-only", "audit_header = 0 and audit_name > 0", 0.06),
    ("vm-audit", "label-density-high", "labels >= 100", 0.23),
    ("vm-audit", "label-density", "labels >= 8 and labels < 100", 0.14),
    ("vm-audit", "goto-graph-high", "gotos >= 50", 0.12),
    ("vm-audit", "goto-graph", "gotos >= 4 and gotos < 50", 0.07),
    ("vm-audit", "function-metadata-many", "metadata >= 2", 0.16),
    ("vm-audit", "function-metadata", "metadata = 1", 0.1),
    ("vm-audit", "vm-fragments", "fragments > 0", 0.12),
    ("vm-audit", "classification", "kind = 'vm-audit-ir'", 0.13),
    ("protected-loader", "header", "loader_header > 0", 0.46),
    ("protected-loader", "stream-pair", "loader_streams > 0", 0.36),
    ("protected-loader", "decoder", "loader_literals = 3", 0.18),
    ("protected-loader", "filename", "loader_name", 0.04),
]
SELECT_AT, SELECT_MARGIN = 0.7, 0.15

# Encoded streams: their literals, and how many signs at a body's start may not belong to it.
STREAM = r"""\[(=*)\[LPH[\s\S]*?\]\1\]|"LPH[^"\n]*"|'LPH[^'\n]*'"""
STREAM_SKIPS = [4, 14, 9, 19]

# Static facts on masked code.
REGISTERS = r"\b(?:L\d+_\d+|A\d+_\d+)\b"
CALLS = r"\b[A-Za-z_]\w*(?:\s*[.:]\s*[A-Za-z_]\w*)*\s*\("
VARARGS = r"\.\.\."

# Words looked for in printable runs.
INDICATORS = [
    "loadstring", "setfenv", "getfenv", "debug", "identifyexecutor", "HttpService", "GetAsync", "PostAsync", "RequestAsync",
    "GetService", "ScreenGui", "TextButton", "Path2D", "CFrame", "writeu8", "readu32", "buffer", "bit32",
]

# Audit listings.
FUNCTION = r"^local function\s+([A-Za-z_]\w*)\s*\("
LABEL = r"::(L\d+)::"
GOTO = r"\bgoto\s+(L\d+)\b"
METADATA = r"(?i)stack slots:\s*\d+;\s*decoded instructions:\s*(\d+);\s*reachable CFG instructions:\s*(\d+)"
PATCHES = r"(?i)statically applied array patches:\s*(\d+);\s*unreachable PCs omitted:\s*(\d+)"

# Opcodes of the record machine at selector 0: (opcode, name, effect kind, target channel of a branch).
OPCODES = [
    (1, "NEW_TABLE_WITH_ARRAY_CAPACITY", "assign", None),
    (5, "COMPARE_REG_NE_REG", "assign", None),
    (9, "SET_TABLE_CONST", "store", None),
    (10, "ADD_CONST_REG", "assign", None),
    (14, "COMPARE_REG_LE_REG", "assign", None),
    (20, "CALL_ONE_ARGUMENT_NO_RESULTS", "call", None),
    (21, "JUMP_IF_TRUTHY", "test", "n"),
    (22, "COMPARE_REG_LE_CONST", "assign", None),
    (25, "LOAD_NIL", "assign", None),
    (34, "SUBTRACT_REG_REG", "assign", None),
    (36, "CALL_RANGE_ONE_RESULT", "call", None),
    (41, "COMPARE_REG_EQ_CONST", "assign", None),
    (50, "TAILCALL_ONE_ARGUMENT", "tailcall", None),
    (58, "JUMP_IF_FALSY", "test", "n"),
    (59, "ADD_REG_CONST", "assign", None),
    (62, "CALL_GENERIC", "call", None),
    (69, "JUMP_IF_REG_LE_CONST", "compare-jump", "q"),
    (71, "LOAD_CONSTANT", "assign", None),
    (72, "MULTIPLY_CONST_CONST", "assign", None),
    (73, "NUMERIC_FOR_LOOP", "for-loop", "a"),
    (75, "TABLE_MOVE", "move", None),
    (77, "COMPARE_CONST_LE_REG", "assign", None),
    (79, "RETURN_RANGE_CLOSE_UPVALUES", "return", None),
    (84, "CREATE_CLOSURE", "assign", None),
    (87, "CALL_TWO_ARGUMENTS_ONE_RESULT", "call", None),
    (97, "SELF_LOOKUP", "self", None),
    (105, "COMPARE_REG_GE_REG", "assign", None),
    (118, "RETURN_ZERO_RESULTS_CLOSE_UPVALUES", "return", None),
    (120, "LOAD_RUNTIME_SLOT", "assign", None),
    (123, "CALL_OPEN_ARGUMENTS_ONE_RESULT", "call", None),
    (125, "ADD_REG_REG", "assign", None),
    (126, "SET_TABLE", "store", None),
    (127, "COMPARE_REG_EQ_REG", "assign", None),
    (129, "COPY_INCOMING_VARARGS_PREFIX", "varargs", None),
    (131, "CALL_ZERO_ARGUMENTS_NO_RESULTS", "call", None),
    (135, "ADD_CONST_CONST", "assign", None),
    (136, "JUMP", "jump", "n"),
    (137, "SUBTRACT_CONST_CONST", "assign", None),
    (138, "COMPARE_REG_GT_CONST", "assign", None),
    (143, "RIGHT_SHIFT_REG_REG", "assign", None),
    (144, "JUMP_IF_REG_NE_CONST", "compare-jump", "n"),
    (147, "COMPARE_REG_NE_CONST", "assign", None),
    (150, "COMPARE_REG_GE_CONST", "assign", None),
    (154, "COPY_VARARGS", "varargs", None),
    (155, "GET_TABLE_CONST", "assign", None),
    (161, "JUMP_IF_REG_LT_REG", "compare-jump", "a"),
    (162, "LENGTH", "assign", None),
    (164, "RIGHT_SHIFT_REG_IMMEDIATE", "assign", None),
    (176, "NUMERIC_FOR_PREP", "for-prep", "a"),
    (187, "MOVE", "assign", None),
    (188, "NEW_TABLE", "assign", None),
    (192, "CLEAR_REGISTER_RANGE", "clear", None),
    (193, "CALL_TWO_ARGUMENTS_NO_RESULTS", "call", None),
    (198, "COMPARE_REG_LT_REG", "assign", None),
    (199, "JUMP_IF_REG_GE_CONST", "compare-jump", "n"),
    (208, "COMPARE_REG_GT_REG", "assign", None),
    (212, "DIVIDE_REG_CONST", "assign", None),
    (215, "GET_TABLE_REG", "assign", None),
    (216, "JUMP_IF_REG_NE_REG", "compare-jump", "n"),
    (219, "RETURN_ONE_RESULT_CLOSE_UPVALUES", "return", None),
    (230, "MODULO_REG_CONST", "assign", None),
    (233, "CALL_RANGE_NO_RESULTS", "call", None),
    (250, "MULTIPLY_REG_REG", "assign", None),
    (251, "CALL_ONE_ARGUMENT_ONE_RESULT", "call", None),
    (252, "SUBTRACT_REG_CONST", "assign", None),
    (253, "SET_TABLE_REG", "store", None),
    (255, "COMPARE_REG_LT_CONST", "assign", None),
    (259, "CALL_ZERO_ARGUMENTS_ONE_RESULT", "call", None),
    (263, "SUBTRACT_CONST_REG", "assign", None),
    (266, "MULTIPLY_REG_CONST", "assign", None),
    (267, "LOAD_UPVALUE", "assign", None),
    (271, "LOAD_ENVIRONMENT_KEY", "assign", None),
]
PROTOCOL_OPCODES = [39, 51, 52, 56, 81, 91, 98, 166, 203, 238, 239, 244, 247, 248, 277, 282]
REGISTER_MODE, REGISTER_SLACK = 7, 4
# The largest register that each opcode's effect names, of the payloads a, n, q; -1: none.
LARGEST_REGISTER = {
    1: "a", 5: "greatest(q, a, n)", 9: "n", 10: "greatest(n, q)", 14: "greatest(n, a, q)", 20: "n + 1", 21: "a", 22: "greatest(n, q)", 25: "q", 34: "greatest(a, q, n)",
    36: "n + 1 + greatest(0, q - 2)", 41: "greatest(n, q)", 50: "n + 1", 58: "a", 59: "greatest(q, n)",
    62: "greatest(a + 1 + case when n = 0 then 0 else greatest(0, n - 2) end, a + greatest(0, q - 2))", 69: "a", 71: "n", 72: "n", 73: "-1",
    75: "a + n", 77: "greatest(a, n)", 79: "n + greatest(0, q - 2)", 84: "a", 87: "q + 2", 97: "greatest(a + 1, n)", 105: "greatest(q, a, n)", 118: "-1", 120: "q", 123: "n + 1",
    125: "greatest(n, a, q)", 126: "greatest(a, n)", 127: "greatest(n, a, q)", 129: "1 + greatest(0, q - 1)", 131: "n + 1", 135: "n", 136: "-1", 137: "q", 138: "greatest(a, n)", 143: "greatest(n, a, q)",
    144: "q", 147: "greatest(q, a)", 150: "greatest(a, q)", 154: "q + greatest(0, a - 1)", 155: "greatest(n, q)", 161: "greatest(n, q)", 162: "greatest(n, q)", 164: "greatest(a, n)", 176: "-1", 187: "greatest(n, a)",
    188: "q", 192: "greatest(a, q)", 193: "n + 2", 198: "greatest(a, n, q)", 199: "q", 208: "greatest(a, n, q)", 212: "greatest(q, n)", 215: "greatest(q, n, a)", 216: "greatest(q, a)", 219: "q",
    230: "greatest(q, n)", 233: "a + 1 + greatest(0, q - 2)", 250: "greatest(a, q, n)", 251: "a + 1", 252: "greatest(a, q)", 253: "greatest(q, n, a)", 255: "greatest(q, n)", 259: "q + 1", 263: "greatest(n, a)", 266: "greatest(n, q)",
    267: "q", 271: "q",
}

# Lua 5.1 opcodes in order of their numbers; those with one wide operand; those that branch.
LUA51 = (
    "MOVE LOADK LOADBOOL LOADNIL GETUPVAL GETGLOBAL GETTABLE SETGLOBAL SETUPVAL SETTABLE NEWTABLE SELF ADD SUB MUL DIV MOD POW UNM "
    "NOT LEN CONCAT JMP EQ LT LE TEST TESTSET CALL TAILCALL RETURN FORLOOP FORPREP TFORLOOP SETLIST CLOSE CLOSURE VARARG"
).split()
LUA51_ABX = [1, 5, 7, 36]
LUA51_ASBX = [22, 31, 32]

# Unresolved opcodes of the record machine that keep state between instructions.
MICRO_OPCODES = [3, 7, 32, 38, 39, 52, 55, 56, 61, 109, 141, 151, 174, 175, 184, 206, 211, 214, 223, 237, 241, 243, 246, 275, 280]

# Buffer functions that a loader may use.
BUFFER_APIS = (
    "fromstring len readi8 readu8 readi16 readu16 readi32 readu32 readf32 readf64 writei8 writeu8 writei16 writeu16 writei32 writeu32 writef32 writef64"
).split()
METHODS_REPORTED = 30

# Readable strings of a payload: signs kept, strings reported, least letters and readable share, points.
STRING_CHARS, STRING_VALUE_CHARS, STRINGS_REPORTED = 1024, 240, 160
STRING_LETTERS, STRING_SHARE = 3, 0.55
INDICATOR_POINTS, SHARE_POINTS, LENGTH_POINTS = 10_000, 1_000, 300
READABLE = r"[A-Za-z0-9 _.:/()\[\]{}-]"

# Media types of inputs, and the share of printable signs from which on text counts as source.
MEDIA_SOURCE, MEDIA_BYTES, PRINTABLE_SHARE = "text/x-lua; charset=utf-8", "application/octet-stream", 0.97
LUA51_SIGNATURE = "1B4C756151"

# The registers that each opcode's effect reads and writes, of the payloads a, n, q; lo..hi is a span, and
# of calls with an open number of arguments or results only the first is named.
REGISTER_EFFECTS = {
    1: ("", "a"), 5: ("a, n", "q"), 9: ("n", ""), 10: ("q", "n"), 14: ("a, q", "n"), 20: ("n..n + 1", ""), 21: ("a", ""), 22: ("n", "q"), 25: ("", "q"), 34: ("q, n", "a"),
    36: ("n, n + 1..n + q - 1", "n"), 41: ("q", "n"), 50: ("n..n + 1", ""), 58: ("a", ""), 59: ("n", "q"),
    62: ("a, a + 1..a + n - 1", "a..a + q - 2"), 69: ("a", ""), 71: ("", "n"), 72: ("", "n"), 73: ("", "q + 3"),
    75: ("a, a + 1..a + n", ""), 77: ("n", "a"), 79: ("n..n + q - 2", ""), 84: ("", "a"), 87: ("q..q + 2", "q"), 97: ("n", "a..a + 1"), 105: ("a, n", "q"), 118: ("", ""), 120: ("", "q"), 123: ("n..n + 1", "n"),
    125: ("a, q", "n"), 126: ("a, n", ""), 127: ("a, q", "n"), 129: ("", "1..q"), 131: ("n", ""), 135: ("", "n"), 136: ("", ""), 137: ("", "q"), 138: ("n", "a"), 143: ("a, q", "n"),
    144: ("q", ""), 147: ("a", "q"), 150: ("q", "a"), 154: ("", "q..q + a - 1"), 155: ("q", "n"), 161: ("n, q", ""), 162: ("q", "n"), 164: ("n", "a"), 176: ("q", ""), 187: ("a", "n"),
    188: ("", "q"), 192: ("", "a..q"), 193: ("n..n + 2", ""), 198: ("n, q", "a"), 199: ("q", ""), 208: ("n, q", "a"), 212: ("n", "q"), 215: ("n, a", "q"), 216: ("q, a", ""), 219: ("q", ""),
    230: ("q", "n"), 233: ("a, a + 1..a + q - 1", ""), 250: ("q, n", "a"), 251: ("a..a + 1", "a"), 252: ("q", "a"), 253: ("q, n, a", ""), 255: ("n", "q"), 259: ("q", "q"), 263: ("a", "n"), 266: ("q", "n"),
    267: ("", "q"), 271: ("", "q"),
}
# What a call with an open number of arguments or results reads and writes instead: (opcode, access, payload that is 0, register).
OPEN_EFFECTS = [(62, "read", "n", "a + 1"), (62, "write", "q", "a")]
# Opcodes whose result the pool alone decides: (opcode, nil or the sign between operands, operands in order).
POOL_VALUES = [(25, "nil", ""), (71, "", "a"), (72, "*", "qa"), (135, "+", "aq"), (137, "-", "na")]

# Signs that every match of a pattern holds: of each list one at least; in lower case where the pattern ignores case.
HELD = {
    r"(?i)\bMoonSec(?:\s+V3)?\b": [["moonsec"]],
    r"(?i)\b0x[0-9a-f]+\b": [["0x"]],
    r"\\\d{1,3}": [["\\"]],
    r"\bwhile\b[\s\S]{0,100}\bdo\b": [["while"], ["do"]],
    r"(?i)%\s*0x[0-9a-f]+": [["%"], ["0x"]],
    r"\b(?:getfenv|setfenv|_ENV)\b": [["getfenv", "setfenv", "_ENV"]],
    r"(?i)LURAPH PAYLOAD[\s\S]{0,100}DEVIRTUALIZED REGISTER-LEVEL": [["luraph payload"]],
    r"(?i)LURAPH PAYLOAD[\s\S]{0,80}DEVIRTUALIZED REGISTER-LEVEL": [["luraph payload"]],
    r"(?i)\bLuraph\b": [["luraph"]],
    r"::L\d+::": [["::L"]],
    r"\bgoto\s+L\d+\b": [["goto"]],
    r"(?i)stack slots:\s*\d+;\s*decoded instructions:\s*\d+;\s*reachable CFG instructions:\s*\d+": [["stack slots:"]],
    r"(?i)--\s*stack slots:\s*\d+;\s*decoded instructions:": [["stack slots:"]],
    r"\bVM_FRAGMENT\b": [["VM_FRAGMENT"]],
    r"(?i)protected\s+using\s+Luraph\s+Obfuscator\s+v14\.7": [["luraph"], ["protected"]],
    r"local\s+V\s*,\s*y\s*=\s*Y\s*\(\s*\[=\[LPH@V[\s\S]*?\]=\]\s*\)\s*,\s*Y\s*\(\s*\[==\[LPH!": [["LPH@V"]],
    r"(?i)--\s*source path:\s*root(?:\.M\[\d+\])*": [["source path:"]],
    r"\bcontinue\b": [["continue"]],
    r"(?:\+=|-=|\*=|/=|//=|\.\.=)": [["+=", "-=", "*=", "/=", "..="]],
    r"\bexport\s+type\b|\btype\s+[A-Za-z_]\w*\s*=": [["type"], ["export", "="]],
    r"(?:local\s+[A-Za-z_]\w*|function\s*\([^)]*)\s*:\s*[A-Za-z_{(]": [["local", "function"], [":"]],
    r"`(?:\\.|[^`])*`": [["`"]],
    r"=\s*if\b[^\n;]+\bthen\b[^\n;]+\belse\b": [["then"], ["else"], ["="]],
    r"\bfunction\b": [["function"]],
    r"\.\.\.": [["..."]],
    r"\b(?:L\d+_\d+|A\d+_\d+)\b": [["_"]],
    r"\b[A-Za-z_]\w*(?:\s*[.:]\s*[A-Za-z_]\w*)*\s*\(": [["("]],
}

# The index that a call gives after a stream, and escapes of quoted literals that stand for control signs.
DECLARED = r"\s*,\s*(\d{1,4})\s*\)"
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}

# Escapes of short literals by their letter, and limits of folding (bytes of a literal, edits and output of a text).
ESCAPE_BYTES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34, "'": 39}
FOLDED_BYTES, FOLD_EDITS, FOLD_OUTPUT = 65_536, 10_000, 1_048_576
