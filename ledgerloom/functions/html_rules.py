"""Element classes of the public HTML standard that decide the shape of a tree."""

from __future__ import annotations

# Element classes of the public HTML standard.
VOID = set(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
#: Their content is text up to their own end tag; in the second group references are decoded.
RAW_TEXT = "script style xmp iframe noembed noframes noscript".split()
ESCAPABLE_RAW_TEXT = "title textarea".split()
UNESCAPED_OUTPUT = set("script style xmp iframe noembed noframes plaintext".split())
HEAD_ONLY = set("base basefont bgsound link meta title style script noframes noscript template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form header hgroup hr listing main menu nav ol p plaintext pre search section summary ul xmp li dd dt".split()
)
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
SCOPE_EDGE = set("applet caption html table td th marquee object template".split())
BUTTON_EDGE = SCOPE_EDGE | {"button"}
LIST_EDGE = SCOPE_EDGE | {"ol", "ul"}
TABLE_EDGE = {"table", "html", "template"}
CELLS = {"td", "th", "caption"}
LIST_ITEMS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
TABLE_SHELL = set("table tbody tfoot thead tr".split())
SECTIONS = {"tbody", "thead", "tfoot"}
SPECIAL = (
    CLOSES_P | SCOPE_EDGE | VOID - {"track"} | TABLE_SHELL | HEAD_ONLY
    | set("body button colgroup head iframe input noembed select textarea".split())
)
#: Which open element may directly hold a table part; everything above it is closed first.
TABLE_HOLDERS = {
    "td": {"tr", *SECTIONS, "table"},
    "th": {"tr", *SECTIONS, "table"},
    "tr": {*SECTIONS, "table"},
    "tbody": {"table"},
    "thead": {"table"},
    "tfoot": {"table"},
    "caption": {"table"},
    "colgroup": {"table"},
    "col": {"colgroup", "table"},
}
#: Documents whose doctype is absent or matches this are laid out in quirks mode (a table then stays in its p).
LEGACY_DOCTYPE = (
    r"(?i)^(?!html\b)|//(?:IETF|W3O|Netscape|Microsoft)//|DTD HTML (?:2|3|4\.0 )"
    r"|DTD HTML 4\.01 (?:Transitional|Frameset)//EN[\"']\s*$"
)
