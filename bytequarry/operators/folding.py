"""Short literals joined by ``..`` folded into one, as edits of spans and the text after them.

Nothing is evaluated but literals and the brackets around them. Concatenation
groups to the right, so of a chain only the literals at its end fold, and none if
a sign that binds closer follows; a bracket that calls is no group.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--\[(?P<a>=*)\[[\s\S]*?(?:\](?P=a)\]|\Z)|--[^\n]*)"""
    r"""|(?P<short>"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')|(?P<long>\[(?P<b>=*)\[[\s\S]*?(?:\](?P=b)\]|\Z))"""
    r"""|(?P<join>(?<!\.)\.\.(?![.=]))|(?P<word>[A-Za-z_]\w*|\d(?:\w|\.(?!\.))*)|(?P<sign>\.{3}|[\s\S])""",
    re.ASCII,
)
_ESCAPE = re.compile(r"""\\(?:([abfnrtv\\"'])|([0-9]{1,3})|)""")
#: Only texts in which two literals meet around the operator are looked at.
_MEETING = r"""["'][\s)]*+\.\.[\s(]*+["']"""
_CLOSING = {")": "(", "]": "[", "}": "{"}
#: After these signs and words an operand starts a chain; before those, its last operand belongs to something else.
_BEFORE = {"=", "(", ",", "{", "[", ";", "<", ">", "..", "return", "and", "or", "in", "if", "elseif", "while", "until"}
_CLOSER = set("+-*/%^.:")
_QUOTED = {'"': '\\"', "\\": "\\\\"}
_PLAIN = re.compile(r"[^ !#-\[\]-~]+")


def literal_bytes(raw: str) -> bytes | None:
    """What a short literal stands for; None if it holds an escape whose bytes are not certain."""
    out, at, body = bytearray(), 0, raw[1:-1]
    for m in _ESCAPE.finditer(body):
        value = fixed.ESCAPE_BYTES.get(m[1]) if m[1] else int(m[2]) if m[2] else None
        if value is None or value > 255:
            return None
        out += body[at : m.start()].encode()
        out.append(value)
        at = m.end()
    return bytes(out + body[at:].encode())


def literal(data: bytes) -> str:
    """A double-quoted literal: printable ASCII as it is, other bytes as three digits."""
    return '"' + _PLAIN.sub(lambda m: "".join(_QUOTED.get(c) or f"\\{ord(c):03d}" for c in m[0]), data.decode("latin-1")) + '"'


_EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))


class _Frame:
    """An open bracket: the chain of operands (start, end, bytes or None, edits within) that is being read, whether it is all there is, and what stood before the bracket."""

    def __init__(self, sign: str, start: int, group: bool):
        self.sign, self.start, self.group, self.only, self.joined, self.chain = sign, start, group, True, "", []


def find_edits(text: str, most: float | None = None) -> list[tuple[int, int, bytes]] | None:
    """(start, end, bytes) of the spans that fold, in order; None if brackets don't match. most: bytes of a literal, the fixed number if None."""
    most = fixed.FOLDED_BYTES if most is None else most
    edits, comments, stack, before = [], [], [_Frame("", 0, False)], ""

    def drop(frame: _Frame) -> None:
        for operand in frame.chain:
            edits.extend(operand[3])
        frame.chain = []

    def end(frame: _Frame) -> None:
        size, k = 0, len(frame.chain)
        while k and frame.chain[k - 1][2] is not None and size + len(frame.chain[k - 1][2]) <= most:
            k -= 1
            size += len(frame.chain[k][2])
        tail, frame.chain = frame.chain[k:], frame.chain[:k]
        drop(frame)
        if len(tail) > 1:
            edits.append((tail[0][0], tail[-1][1], b"".join(o[2] for o in tail)))
        else:
            edits.extend(e for o in tail for e in o[3])

    def leave(frame: _Frame, sign: str) -> None:
        """The chain is over, because of a sign or word."""
        whole = before != ".." and sign not in _CLOSER
        if whole and sign in ("(", "[", "{") and frame.chain:
            whole = sign == "(" and text[frame.chain[-1][1] - 1] != ")"
        (end if whole else drop)(frame)
        frame.only = False

    def operand(frame: _Frame, joined: str, value: tuple) -> None:
        if joined != "..":
            leave(frame, "")
            frame.only = joined == "(" and frame.group
        frame.chain.append(value)

    for m in _LEX.finditer(text):
        kind, frame = m.lastgroup, stack[-1]
        if kind == "space":
            continue
        if kind == "comment":
            comments.append(m.start())
            continue
        sign = m[0]
        if kind in ("short", "long"):
            if before in _BEFORE:
                operand(frame, before, (m.start(), m.end(), literal_bytes(sign) if kind == "short" else None, []))
            else:
                before = ".."  # an argument or under a closer sign: what is to its left isn't a literal
                leave(frame, "")
            before = "literal"
            continue
        if sign in ("(", "[", "{"):
            group = sign == "(" and before in _BEFORE
            if not group:
                leave(frame, sign)
            opened = _Frame(sign, m.start(), group)
            opened.joined = before
            stack.append(opened)
        elif sign in _CLOSING:
            if frame.sign != _CLOSING[sign]:
                return None
            parts = frame.chain
            data = b"".join(o[2] for o in parts) if parts and all(o[2] is not None for o in parts) else None
            if frame.group and frame.only and before != ".." and data is not None and len(data) <= most:
                within = [(parts[0][0], parts[-1][1], data)] if len(parts) > 1 else parts[0][3]
                stack.pop()
                operand(stack[-1], frame.joined, (frame.start, m.end(), data, within))
            else:
                leave(frame, "")
                stack.pop()
                if frame.group:
                    before = ".."  # an operand that is no literal
                    leave(stack[-1], "")
        elif kind != "join":
            leave(frame, sign)
        elif not frame.chain:
            frame.only = False
        before = ".." if kind == "join" else sign
    if len(stack) > 1:
        return None
    leave(stack[0], "")
    noted = lambda e: bisect_left(comments, e[0]) == bisect_left(comments, e[1])
    return sorted(e for e in edits if noted(e))


def _folded(text: str | None, limited: bool = True) -> tuple[list[tuple[int, int, str]], str, str | None]:
    if text is None:
        return [], "none", None
    found = find_edits(text, None if limited else math.inf)
    if found is None:
        return [], "unbalanced", text
    if limited and len(found) > fixed.FOLD_EDITS:
        return [], "edit-limit", text
    edits = [(start, stop, literal(data)) for start, stop, data in found]
    if limited and sum(len(e[2]) for e in edits) > fixed.FOLD_OUTPUT:
        return [], "output-limit", text
    out, at = [], 0
    for start, stop, said in edits:
        out += [text[at:start], said]
        at = stop
    return edits, "folded" if edits else "none", "".join([*out, text[at:]])


def _fold(limited: bool):
    @F.pandas_udf(T.StructType([T.StructField("edits", _EDITS), T.StructField("status", T.StringType()), T.StructField("text", T.StringType())]))
    def fold_texts(texts: pd.Series) -> pd.DataFrame:
        rows = [_folded(t, limited) for t in texts]
        return pd.DataFrame({"edits": [[{"start": a, "end": b, "replacement": r} for a, b, r in e] for e, _, _ in rows], "status": [s for _, s, _ in rows], "text": [t for _, _, t in rows]})

    return fold_texts


def fold(sources: DataFrame, text_col: str = "text", limited: bool = True) -> DataFrame:
    """``sources`` with edits, fold_status and folded: non-overlapping spans (code points from 0, end exclusive) in order, and the text after them.

    fold_status is folded, none, unbalanced (brackets don't match), or edit-limit or output-limit where a text
    would take more edits or text than the fixed limits allow; then it stays as it is. Without ``limited`` texts fold whole, whatever their size.
    A span with a comment in it stays. Literals with uncertain escapes, long brackets, and sums beyond the fixed size don't
    fold. Null texts stay null, with no edits. No shuffle; texts without two literals that meet don't go to Python.
    """
    text = F.col(text_col)
    rows = sources.withColumn("_fold", _fold(limited)(F.when(text.rlike(_MEETING), text)))
    return rows.withColumn("edits", F.col("_fold.edits")).withColumn("fold_status", F.col("_fold.status")).withColumn("folded", F.coalesce("_fold.text", text)).drop("_fold")


def edit_rows(folded: DataFrame) -> DataFrame:
    """(artifact_id, start, end, replacement): a row an edit of what ``fold`` gives."""
    # explode would have its input tested first, and so folded twice.
    return folded.select("artifact_id", F.explode_outer("edits").alias("edit")).where("edit is not null").select("artifact_id", "edit.*")
