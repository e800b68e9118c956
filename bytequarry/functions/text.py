"""Column functions over source text."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"

#: Comments, short strings (which may run over lines, and in which a backslash takes the next sign along), long strings,
#: and what lies between. Repeats of groups are possessive, so that long literals need no deep stack.
TOKENS = r"""--\[(=*)\[[\s\S]*?(?:\]\1\]|\z)|--[^\n]*+|"(?:[^"\\]++|\\[\s\S]?+)*+"?+|'(?:[^'\\]++|\\[\s\S]?+)*+'?+|\[(=*)\[[\s\S]*?(?:\]\2\]|\z)|[^-"'\[]++|[\s\S]"""
_MASKED = r"""--|["']|\[=*\["""


def java(pattern: str) -> str:
    """The pattern with word boundaries that only ASCII letters, digits and underscores make.

    Before a letter, and after a letter or a group of words, one look is enough. What is before a single word is looked
    at after it, so that a scan looks for the word's first letter and not around every place.
    """
    if word := re.fullmatch(r"\\b([A-Za-z_]\w*)\\b", pattern):
        return f"{word[1]}(?<!{_WORD}{word[1]})(?!{_WORD})"
    pattern = re.sub(r"\\b(?=(?:\(\?:|\()?(?:[A-Za-z_]|\[A-Za-z_\]))", lambda m: f"(?<!{_WORD})", pattern)
    pattern = re.sub(r"(?<![\\])([A-Za-z]|(?<=[A-Za-z0-9+])(?<!\(\?i)\))\\b", lambda m: f"{m[1]}(?!{_WORD})", pattern)
    return pattern.replace(r"\b", _BOUNDARY)


def may_match(text: Column, pattern: str) -> Column:
    """Whether a text holds the signs without which the pattern can't match; true if none are known.

    Where case doesn't count the sign is looked for as it stands in the text: a copy in lower case costs far more.
    """
    free = lambda w: pattern.startswith("(?i)") and w.lower() != w.upper()
    has = lambda w: text.rlike(f"(?i){re.escape(w)}") if free(w) else F.contains(text, F.lit(w))
    found = [reduce(or_, (has(w) for w in words)) for words in fixed.HELD.get(pattern, [])]
    return reduce(and_, found) if found else F.lit(True)


def count(text: Column, pattern: str) -> Column:
    """Number of matches, from left to right without overlap; a pattern runs only over texts that it may match."""
    found = F.regexp_count(text, F.lit(java(fixed.LINEAR.get(pattern, pattern)))).cast("long")
    return F.when(may_match(text, pattern), found).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long"))) if pattern in fixed.HELD else found


def masked(text: Column) -> Column:
    """Text with comments and strings blanked; line ends and places stay. Backtick strings stay.

    A token's first sign says what it is: a lone hyphen or bracket is code, a longer one a comment or a long string.
    """
    starts = lambda t, *signs: reduce(or_, (t.startswith(F.lit(c)) for c in signs))
    hidden = lambda t: starts(t, '"', "'") | (starts(t, "-", "[") & (F.octet_length(t) > 1))
    spaces = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda x: F.repeat(F.lit(" "), F.length(x))), "\n")
    blank = lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"[^\r\n]", " ")).otherwise(spaces(t))
    tokens = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: F.when(hidden(t), blank(t)).otherwise(t)), "")
    return F.when(text.rlike(_MASKED), tokens).otherwise(text)


def physical_lines(text: Column) -> Column:
    """0 for empty text, else newlines + 1."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def control_share(text: Column) -> Column:
    """Share of control characters other than newline, return and tab."""
    return F.when(text == "", 0.0).otherwise(count(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]") / F.length(text))
