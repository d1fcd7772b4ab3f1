"""Text cleaning and pattern matching as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.  ``trim`` alone strips only U+0020.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (linear; a ``\\s+$`` pattern is quadratic on long runs)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _to_spaces(text: Column, *literals: str) -> Column:
    for literal in literals:
        text = F.replace(text, F.lit(literal), F.lit(" "))
    return text


def clean_start(text: Column) -> Column:
    """Cleaning before a start pattern."""
    return _to_spaces(strip(text), "\n", "&nbsp;", "&#160;")


def clean_end(text: Column) -> Column:
    """Cleaning before an end pattern: the numeric entity stays."""
    return _to_spaces(strip(text), "\n", "&nbsp;")


def clean_toc(text: Column) -> Column:
    """Cleaning before the contents-table check: line breaks stay."""
    return _to_spaces(strip(text), "&nbsp;", "&#160;")


def unicode_pattern(pattern: str) -> str:
    """Spell a pattern so that ``\\s``, ``\\b``, ``\\d`` and case folding are Unicode, and ``$`` means end of text.

    A leading word border before a letter gets that letter as a look-ahead in front: the same
    matches, but the costly Unicode border test runs only where the letter stands.
    """
    if pattern.endswith("$") and not pattern.endswith("\\$"):
        pattern = pattern[:-1] + "\\z"
    pattern = re.sub(r"^((?:\(\?i\))?)\\b([A-Za-z])", r"\1(?=\2)\\b\2", pattern)
    return "(?uU)" + pattern


#: Characters beside its two cases that a letter matches when case is ignored.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _gate(patterns: Sequence[str]) -> str:
    """A look-ahead for the letters that any match must begin with; nothing where a pattern may begin otherwise."""
    letters = set()
    for pattern in patterns:
        first = re.match(r"(?:\(\?i\))?(?:\^|\\b)?([A-Za-z])(?![*?{|])", pattern)
        if first is None or "|" in re.sub(r"\([^()]*\)|\[[^\]]*\]", "", pattern):
            return ""
        letters |= {first[1].lower(), first[1].upper(), *_FOLDED.get(first[1].lower(), "")}
    return f"(?=[{''.join(sorted(letters))}])"


def match_any(text: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern occurs in the text.

    One alternation in one literal: it is compiled once per task and the text is decoded once,
    whatever the number of patterns.  Only whether something matches is asked, so order is irrelevant.  Where all patterns
    begin with a letter, other places are passed over before any pattern is tried.
    """
    every = "|".join(f"(?:{unicode_pattern(p)})" for p in patterns)
    return F.rlike(text, F.lit(f"{_gate(patterns)}(?:{every})"))


def byte_length(text: Column) -> Column:
    """Size in UTF-8 bytes."""
    return F.octet_length(text).cast("bigint")


def byte_slice(utf8: Column, start: Column, length: Column) -> Column:
    """Text of a byte range.

    ``utf8`` is BINARY: a slice is then a copy of ``length`` bytes, where a string ``substring``
    would first walk every character before it.
    """
    return F.substring(utf8, start + F.lit(1), length).cast("string")
