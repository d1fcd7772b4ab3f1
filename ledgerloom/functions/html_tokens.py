"""Markup to tokens, as Spark expressions.

One regular expression cuts a document into its tags, comments and texts without leaving anything out.  The nesting step
gets three fields of each token, all of a document in one string (``fields``): the ``mark`` (a tag's name behind ``<`` or
``</``, the beginning of a comment, a doctype, the first character of white space, nothing for text), the text, and what
stands between a tag's name and its end.  Tokens are spelled out again, as canonical markup, only where a section is
written (``written``, ``text``).
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html_rules import ESCAPABLE_RAW_TEXT, RAW_TEXT

_RAW = "|".join(RAW_TEXT + ESCAPABLE_RAW_TEXT)
#: Everything up to the end of a tag; ``>`` inside a quoted value does not end it. Possessive, so that no long tag
#: makes the matcher go back or recurse.
_INSIDE = r"""[^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+[^>=]*+)*+"""
_NAME = r"[a-zA-Z][^\s/>]*+"
#: A raw element goes up to its own end tag.
_RAW_ELEMENT = rf"(<((?i:{_RAW})))(?=[\s/>])({_INSIDE})>((?s:.*?))(?:</(?i:\2)(?=[\s/>])[^>]*+(?:>|\z)|\z)"
_BLANK = r"(?:[\t\n\f ]|&(?:#0*(?:9|10|12|13|32)|#[xX]0*(?:9|[aA]|[cC]|[dD]|20)|Tab|NewLine);)"
STREAM = "|".join(
    [
        _RAW_ELEMENT,
        rf"(</?{_NAME})({_INSIDE})>",
        rf"(?=({_BLANK}))({_BLANK}++)",
        r"((?:[^<]++|<(?![a-zA-Z!/?]))++)",
        r"(<!--)(?:-?>|(?s:.*?)(?:--!?>|\z))",
        "(</>)",
        r"(<(?i:!doctype)[^>]*+)(?:>|\z)",
        r"(<[!?]|</(?![a-zA-Z]))[^>]*+(?:>|\z)",
        rf"</?{_NAME}{_INSIDE}\z",  # cut off: no token
    ]
)
#: Of every alternative the groups that make up a token's mark, text and inside; a group that took no part is empty.
_FIELDS = "$1$5$7$10$11$12$13\0$4$8$9\0$3$6\0"
#: Most tags and texts are canonical as they stand: no attribute twice, nothing to decode or to escape.
_CANONICAL_TAG = r"""^(?!.* ([a-z-]++)=.* \1=)<[a-z][a-z0-9]*+(?: [a-z-]++="[^"&\u00a0]*+")*+>\z"""
_CANONICAL_TEXT = r"^(?:[^&<>\u00a0]++|&(?:amp|lt|gt|nbsp);)*+\z"
_ATTRIBUTE = r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+"""

_REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[^\t\n\f <&#;]{1,32}+;?+)"
_ATTRIBUTE_REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[A-Za-z][A-Za-z0-9]*+;?+)=?+"
_COMMON = {"&nbsp;": "\u00a0", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
_LEGACY_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
#: What the references 128 to 159 stand for.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_names(use) -> Column:
    """``use(names)`` with the table of all named references (names, characters), which stands in the plan once."""
    listed = [F.split(F.lit("\x01".join(side)), "\x01") for side in (html5, html5.values())]
    return _once(F.array(*listed), use)


def _named(names: Column, name: Column) -> Column:
    """The characters of a named reference, null for an unknown one."""
    return F.get(F.get(names, F.lit(1)), (F.array_position(F.get(names, F.lit(0)), name) - 1).cast("int"))


def _numeric(reference: Column) -> Column:
    hexadecimal = F.rlike(reference, F.lit("^&#[xX]"))
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    )

    def character(n: Column) -> Column:
        utf32 = F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))
        nothing = n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534) | n.between(1, 8) | n.between(14, 31) | n.isin(11, 127)
        return (
            F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(128, 159), F.substring(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1)))
            .when(nothing, "")
            .otherwise(F.decode(F.unhex(utf32), "UTF-32"))
        )

    return _once(code, character)


def _name_of(reference: Column) -> Column:
    return F.substring(reference, F.lit(2), F.length(reference))


def _decoded(reference: Column, names: Column) -> Column:
    """What one character reference stands for; an unknown one for itself, but for a known beginning."""

    def other(name: Column) -> Column:
        start = F.regexp_extract(name, _LEGACY_NAMES, 1)
        partly = F.concat(_named(names, start), F.substring(name, F.length(start) + 1, F.length(name)))
        return F.coalesce(_named(names, name), F.when(start != "", partly), F.concat(F.lit("&"), name))

    common = F.lit(None).cast("string")
    for written, character in _COMMON.items():
        common = F.when(reference == written, character).otherwise(common)
    numeric = F.when(F.startswith(reference, F.lit("&#")), _numeric(reference))
    return F.coalesce(common, numeric, _once(_name_of(reference), other))


def _attribute_decoded(reference: Column, names: Column) -> Column:
    """In a value a name without semicolon counts only if it is known and no ``=`` follows."""
    equals = F.endswith(reference, F.lit("="))
    body = F.when(equals, F.left(reference, F.length(reference) - 1)).otherwise(reference)

    def decoded(body: Column) -> Column:
        bare = ~F.startswith(body, F.lit("&#")) & ~F.endswith(body, F.lit(";"))
        return F.when(bare & (equals | _named(names, _name_of(body)).isNull()), reference).otherwise(
            F.concat(_decoded(body, names), F.when(equals, "=").otherwise(""))
        )

    return _once(body, decoded)


def _decode(value: Column, pattern: str, decode, names: Column) -> Column:
    """The value with every reference replaced."""
    pieces = F.zip_with(
        F.split(value, pattern, -1),
        F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda reference: decode(reference, names)),
        lambda gap, character: F.concat(gap, F.coalesce(character, F.lit(""))),
    )
    return F.when(F.contains(value, F.lit("&")), F.array_join(pieces, "")).otherwise(value)


def plain(markup: Column) -> Column:
    """The markup with plain line breaks and without NUL."""
    return F.replace(F.replace(F.replace(markup, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\0"), F.lit(""))


def fields(markup: Column) -> Column:
    """Mark, text and inside of every token of a ``plain`` document, each followed by NUL."""
    return F.regexp_replace(markup, F.lit(STREAM), F.lit(_FIELDS))


def tokens(markup: Column) -> Column:
    """The tokens of a ``plain`` document as they are written."""
    return F.regexp_extract_all(markup, F.lit(STREAM), F.lit(0))


def text(token: Column, names: Column) -> Column:
    """What a token adds to the document's text: itself, or the content of a raw element."""
    decode = lambda value: _decode(value, _REFERENCE, _decoded, names)
    content = F.regexp_extract(token, _RAW_ELEMENT, 4)
    name = F.lower(F.regexp_extract(token, _RAW_ELEMENT, 2))
    area = F.when(name == "textarea", F.regexp_replace(content, r"^\n", "")).otherwise(content)
    raw = F.when(name.isin(*ESCAPABLE_RAW_TEXT), decode(area)).otherwise(content)
    return F.when(F.rlike(token, F.lit("^<[a-zA-Z]")), raw).otherwise(decode(token))


def _attributes(inside: Column, table: Column) -> Column:
    """``array<struct<name, value>>`` of a tag; of equal names the first counts."""
    names = F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    double, single, bare = (F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(group)) for group in (2, 3, 4))

    def pairs(names: Column, parts: Column) -> Column:
        value = lambda i: F.concat(*[F.get(F.get(parts, F.lit(k)), i) for k in range(3)])
        every = F.transform(names, lambda name, i: F.struct(name.alias("name"), _decode(value(i), _ATTRIBUTE_REFERENCE, _attribute_decoded, table).alias("value")))
        return F.filter(every, lambda a, i: F.array_position(names, a["name"]) == i + 1)

    return _once(names, lambda names: _once(F.array(double, single, bare), lambda parts: pairs(names, parts)))


def escaped(text: Column) -> Column:
    for character, written in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(written))
    return text


def escaped_text(token: Column, names: Column) -> Column:
    """A token's text as it stands in canonical markup."""
    return F.when(F.rlike(token, F.lit(_CANONICAL_TEXT)), token).otherwise(escaped(text(token, names)))


def written(token: Column, names: Column) -> Column:
    """A start tag or comment as canonical markup."""

    def value(raw: Column) -> Column:
        for character, entity in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ('"', "&quot;")):
            raw = F.replace(raw, F.lit(character), F.lit(entity))
        return raw

    data = F.when(
        F.startswith(token, F.lit("<!--")), F.regexp_extract(token, r"(?s)^<!--(?:-?>|(.*?)(?:--!?>|\z))", 1)
    ).otherwise(F.regexp_extract(token, r"(?s)^<(?:!|(?=\?)|/)([^>]*)", 1))
    name = F.lower(F.regexp_extract(token, rf"^<({_NAME})", 1))
    inside = F.regexp_extract(token, rf"^<{_NAME}({_INSIDE})>", 1)
    pairs = F.transform(_attributes(inside, names), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), value(a["value"]), F.lit('"')))
    tag = F.concat(F.lit("<"), name, F.array_join(pairs, ""), F.lit(">"))
    other = F.when(F.rlike(token, F.lit("^<[a-zA-Z]")), tag).otherwise(F.concat(F.lit("<!--"), data, F.lit("-->")))
    return F.when(F.rlike(token, F.lit(_CANONICAL_TAG)), token).otherwise(other)
