"""Where a section starts and ends inside one document.

Everything here is an expression over the preorder ``nodes`` array.  Preorder makes ancestry an
interval test (``a`` is above ``n`` when ``a.node_id < n.node_id <= a.last_desc``), "inside any
contents mark seen so far" a comparison with the furthest end of those marks, and "everything after
the start under the same parent" an array slice.

``mode="reference"`` (the default) takes the outermost match, wherever it stands.  ``mode="strict"`` takes
the innermost one, checks it for contents marks itself too, wants the mark to be a word of the class
or id, climbs from a match to the block that holds nothing else, searches on behind that block's parent, and cuts where
the end stands, also inside a half-open element.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import match_places, sweep
from ..functions.text import clean_end, clean_start, clean_toc, match_any, strip, unicode_pattern
from .nodes import NODE, bound, is_header, node_text

# The section, its start and end patterns, and the marks of a table of contents.
SECTION_NAME = "Item 8"
SECTION_TITLE = "Financial Statements and Supplementary Data"
START_PATTERNS = (
    r"(?i)^\s*Item\s*8\.?\s*Financial\s*Statements\s*(?:and\s*Supplementary\s*Data)?\.?\s*$",
    r"(?i)\bItem\s*8[\.\s\-–—:]+Financial\s*Statements",
)
END_PATTERNS = (
    r"(?i)^Item\s*9[ABC]?\.?\s*[Cc]hanges\b",
    r"(?i)\bItem\s*9[ABC]?\.?\s",
    r"(?i)^PART\s+III\b",
    r"(?i)\bPART\s+III\b",
    r"(?i)^Item\s*10\.?\s*[Dd]irectors\b",
    r"(?i)\bItem\s*10\.?\s",
    r"(?i)\bSIGNATURES\b",
    r"(?i)\bEXHIBIT\s+INDEX\b",
    r"(?i)\bEXHIBITS?\b",
)
END_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "font"]
#: Every start match holds this, white space and what cleaning makes of entities included.
START_PROBE = r"(?i)8(?:[.\s\-–—:]|&nbsp;|&#160;)*Financial"
#: Every end match holds one of these.
END_PROBE = r"(?i)Item(?:\s|&nbsp;)*(?:9|10)|Part(?:\s|&nbsp;)+III|Signatures|Exhibit"
TOC_TAGS = ["div", "nav"]
TOC_MARK = "toc"
TABLE_TAGS = ["td", "tr", "table"]
TOC_ITEM_PATTERN = r"^\s*Item\s+\d+[A-Z]?\.?\s*$"
MIN_SECTION_BYTES = 1000


@dataclass(frozen=True)
class SectionRule:
    """What to look for.

    ``start_probe`` must be a pattern without which no start pattern can match, ``end_probe`` likewise; they are sought
    once in a document's text, and only elements that hold a place of one are tested.  None switches the short cut
    off, and so do patterns of one's own without a probe of their own.
    """

    name: str = SECTION_NAME
    title: str = SECTION_TITLE
    start_patterns: Sequence[str] = START_PATTERNS
    end_patterns: Sequence[str] = END_PATTERNS
    min_bytes: int = MIN_SECTION_BYTES
    start_probe: str | None = START_PROBE
    end_probe: str | None = END_PROBE
    mode: str = "reference"

    def __post_init__(self) -> None:
        for side, patterns, probe in (("start", START_PATTERNS, START_PROBE), ("end", END_PATTERNS, END_PROBE)):
            if tuple(getattr(self, f"{side}_patterns")) != patterns and getattr(self, f"{side}_probe") == probe:
                object.__setattr__(self, f"{side}_probe", None)
        if self.mode not in ("reference", "strict"):
            raise ValueError(f"mode must be 'reference' or 'strict', not {self.mode!r}")


ITEM_8 = SectionRule()


# --- predicates on one node ----------------------------------------------------------------------
def is_link(node: Column) -> Column:
    """An anchor with an address: taken for a contents entry."""
    return (node["tag"] == "a") & node["has_href"]


def is_toc_container(node: Column) -> Column:
    """A div or nav whose class or id holds the contents mark anywhere (so ``stock`` counts too)."""
    marked = F.coalesce(F.contains(node["attr_class"], F.lit(TOC_MARK)), F.lit(False)) | F.coalesce(
        F.contains(node["attr_id"], F.lit(TOC_MARK)), F.lit(False)
    )
    return node["tag"].isin(TOC_TAGS) & marked


def is_named_toc(node: Column) -> Column:
    """A div or nav whose class or id has the contents mark as a word of its own."""
    word = rf"(?:^|[\s_-]){TOC_MARK}(?:$|[\s_-])"
    marked = [F.coalesce(F.rlike(node[name], F.lit(word)), F.lit(False)) for name in ("attr_class", "attr_id")]
    return node["tag"].isin(TOC_TAGS) & (marked[0] | marked[1])


def is_above(ancestor: Column, node: Column) -> Column:
    return (ancestor["node_id"] < node["node_id"]) & (node["node_id"] <= ancestor["last_desc"])


def is_toc_item_text(text: Column) -> Column:
    return match_any(clean_toc(text), [TOC_ITEM_PATTERN])


def is_start_text(text: Column, rule: SectionRule) -> Column:
    return match_any(clean_start(text), rule.start_patterns)


def is_end_text(text: Column, rule: SectionRule) -> Column:
    return match_any(clean_end(text), rule.end_patterns)


# --- steps, one row per document -----------------------------------------------------------------
CANDIDATE = f"struct<node:{NODE.simpleString()},in_toc:boolean,in_table:boolean>"


def candidates(parsed: DataFrame, rule: SectionRule | None = None) -> DataFrame:
    """``candidates``: the elements that may carry a header, with what stands above them: ``in_toc`` (a contents block
    or a link) and ``in_table``.  With a rule only those whose text holds its probe; its mode says what a contents
    block is, and whether an element counts as inside itself.

    One walk over the nodes.  It carries how far the contents marks and tables opened so far reach, so no candidate is
    compared with all marks, and the first probe that does not lie behind, so hardly any with all probes.
    """
    strict = rule is not None and rule.mode == "strict"
    is_toc = is_named_toc if strict else is_toc_container
    probe = rule.start_probe if rule else None

    def walk(probes: Column) -> Column:
        def step(state: Column, n: Column, index: Column) -> tuple[dict[str, Column], Column, Column]:
            def reach(name: str, opens: Column) -> Column:
                return F.when(opens, F.greatest(state[name], n["last_desc"])).otherwise(state[name])

            no = F.lit(False)
            toc, table = reach("toc", F.coalesce(is_toc(n) | is_link(n), no)), reach("table", F.coalesce(n["tag"].isin(TABLE_TAGS), no))
            following, wanted = {"toc": toc, "table": table}, F.coalesce(is_header(n), no)
            if probe:
                following["probe"] = _next_probe(probes, state["probe"], n)
                wanted = wanted & _holds_probe(probes, following["probe"], n)
            in_toc, in_table = n["node_id"] <= (toc if strict else state["toc"]), n["node_id"] <= state["table"]
            return following, wanted, 4 * index + 2 * in_toc.cast("int") + in_table.cast("int")

        def candidate(code: Column) -> Column:
            node = F.get("nodes", F.shiftright(code, 2).cast("int"))
            flags = {"in_toc": 2, "in_table": 1}
            return F.struct(node.alias("node"), *[(code.bitwiseAND(F.lit(bit).cast("bigint")) > 0).alias(name) for name, bit in flags.items()])

        zero = {"toc": F.lit(-1), "table": F.lit(-1)} | ({"probe": F.lit(0)} if probe else {})
        return F.transform(sweep("nodes", zero, step), candidate)

    if not probe:
        return parsed.withColumn("candidates", walk(F.lit(None)))
    none = F.expr(f"cast(array() as array<{CANDIDATE}>)")
    return parsed.withColumn("candidates", bound(_places(probe), lambda probes: F.when(F.size(probes) == 0, none).otherwise(walk(probes))))


def _places(probe: str) -> Column:
    return match_places(F.col("doc_text").cast("string"), unicode_pattern(probe))


#: Probes passed over at a time; elements between which more of them stand are compared with all that follow.
PROBE_STEP = 16


def _next_probe(probes: Column, at: Column, n: Column) -> Column:
    """The first probe that does not start before the node, as far as one step goes."""
    behind = F.filter(F.slice(probes, at + 1, PROBE_STEP), lambda p: p["start"] < n["text_start"])
    return F.when(F.get(probes, at)["start"] < n["text_start"], at + F.size(behind)).otherwise(at)


def _holds_probe(probes: Column, at: Column, n: Column) -> Column:
    end = n["text_start"] + n["text_len"]
    first = F.get(probes, at)
    inside = lambda p: (p["start"] >= n["text_start"]) & (p["end"] <= end)
    late = F.exists(F.slice(probes, at + 1, F.lit(2**31 - 1) - at), inside)
    return F.coalesce(F.when(first["start"] < n["text_start"], late).otherwise(first["end"] <= end), F.lit(False))


def start_matches(parsed: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``starts``: candidates whose text matches a start pattern, in document order."""
    found = bound(
        "doc_text", lambda text: F.filter("candidates", lambda c: is_start_text(node_text(text, c["node"]), rule))
    )
    return candidates(parsed, rule).withColumn("starts", found).drop("candidates")


def is_toc_table_item(candidate: Column, doc_text: Column) -> Column:
    """Inside a table and nothing but an item number."""
    return candidate["in_table"] & is_toc_item_text(node_text(doc_text, candidate["node"]))


def in_toc(candidate: Column, doc_text: Column) -> Column:
    return is_link(candidate["node"]) | candidate["in_toc"] | is_toc_table_item(candidate, doc_text)


def first_start(parsed: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``start``: the first start match outside a table of contents, or null.

    Folded instead of filtered: no text is tested after the first hit.
    """
    if rule.mode == "strict":
        return _first_strict_start(parsed, rule)

    def fold(text: Column) -> Column:
        number = F.aggregate(
            "candidates",
            F.lit(None).cast("int"),
            lambda found, c: F.coalesce(
                found, F.when(is_start_text(node_text(text, c["node"]), rule) & ~in_toc(c, text), c["node"]["node_id"])
            ),
        )
        return F.get("nodes", number)

    return candidates(parsed, rule).withColumn("start", bound("doc_text", fold)).drop("candidates")


# --- strict mode ---------------------------------------------------------------------------------
def _innermost(items: Column | str, node_of, matches, accepted) -> Column:
    """The first match that holds no other match and is accepted.

    In preorder what an element holds comes right after it, so the last match is innermost as soon as the next one stands
    outside of it.  Nothing is tested once one is found.
    """
    nothing = F.lit(None).cast(NODE)

    def step(state: Column, item: Column) -> Column:
        n = node_of(item)
        inside = F.coalesce(n["node_id"] <= state["last"]["last_desc"], F.lit(False))
        settled = F.when(state["good"] & ~inside, state["last"])
        moved = F.struct(settled.alias("found"), n.alias("last"), accepted(item).alias("good"))
        tested = F.when(F.coalesce(matches(item), F.lit(False)), F.when(settled.isNull(), moved).otherwise(F.struct(settled.alias("found"), state["last"].alias("last"), state["good"].alias("good"))))
        return F.when(state["found"].isNotNull(), state).otherwise(F.coalesce(tested, state))

    zero = F.struct(nothing.alias("found"), nothing.alias("last"), F.lit(False).alias("good"))
    return F.aggregate(items, zero, step, lambda state: F.coalesce(state["found"], F.when(state["good"], state["last"])))


def _climbed(node: Column, text: Column, may_climb) -> Column:
    """From a node upwards for as long as ``may_climb(node, parent, text)``, innermost parent first."""
    above = F.filter("nodes", lambda a: is_above(a, node) & ~a["tag"].isin("html", "body"))
    zero = F.struct(node.alias("node"), F.lit(False).alias("stop"))

    def step(state: Column, parent: Column) -> Column:
        climbs = ~state["stop"] & F.coalesce(may_climb(state["node"], parent, text), F.lit(False))
        return F.when(climbs, F.struct(parent.alias("node"), F.lit(False).alias("stop"))).otherwise(
            F.struct(state["node"].alias("node"), F.lit(True).alias("stop"))
        )

    return F.aggregate(F.reverse(above), zero, step, lambda state: state["node"])


def _blank(text: Column, start: Column, end: Column) -> Column:
    return strip(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))).cast("string")) == ""


def _first_strict_start(parsed: DataFrame, rule: SectionRule) -> DataFrame:
    def holds_nothing_else(node: Column, parent: Column, text: Column) -> Column:
        end, parent_end = node["text_start"] + node["text_len"], parent["text_start"] + parent["text_len"]
        return _blank(text, parent["text_start"], node["text_start"]) & _blank(text, end, parent_end)

    def search(text: Column) -> Column:
        found = _innermost(
            "candidates", lambda c: c["node"], lambda c: is_start_text(node_text(text, c["node"]), rule), lambda c: ~in_toc(c, text)
        )
        return bound(found, lambda node: F.when(node.isNotNull(), _climbed(node, text, holds_nothing_else)))

    return candidates(parsed, rule).withColumn("start", bound("doc_text", search)).drop("candidates")


def _probed(nodes: Column, probe: str | None) -> Column:
    """The nodes whose text holds a place of the probe."""
    if not probe:
        return nodes

    def walk(probes: Column) -> Column:
        def step(state: Column, n: Column, index: Column) -> tuple[dict[str, Column], Column, Column]:
            at = _next_probe(probes, state["probe"], n)
            return {"probe": at}, _holds_probe(probes, at, n), index

        return F.transform(sweep(nodes, {"probe": F.lit(0)}, step), lambda i: F.get(nodes, i.cast("int")))

    return bound(_places(probe), lambda probes: F.when(F.size(probes) == 0, F.slice(nodes, F.lit(1), F.lit(0))).otherwise(walk(probes)))


def _first_strict_end(followed: DataFrame, rule: SectionRule) -> DataFrame:
    """The first innermost end marker behind the start, and as far up as it is the first thing in its block."""

    def opens(node: Column, parent: Column, text: Column) -> Column:
        before = F.slice("nodes", parent["node_id"] + 2, F.greatest(node["node_id"] - parent["node_id"] - 1, F.lit(0)))
        behind_start = parent["node_id"] > F.col("start")["last_desc"]
        return behind_start & _blank(text, parent["text_start"], node["text_start"]) & ~F.exists(before, lambda n: n["kind"] == "element")

    def search(text: Column) -> Column:
        tag = lambda n: F.coalesce(is_header(n) | n["tag"].isin(END_TAGS), F.lit(False))
        is_marker = lambda n: tag(n) & is_end_text(node_text(text, n), rule)
        found = _innermost(_probed(F.col("following"), rule.end_probe), lambda n: n, is_marker, lambda n: F.lit(True))
        return bound(found, lambda node: F.when(node.isNotNull(), _climbed(node, text, opens)))

    return followed.withColumn("end", bound("doc_text", search))


# --- from the start to the end -------------------------------------------------------------------
def following_nodes(started: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``following``: every node after the start and its subtree, under the same parent (in strict mode up to the end
    of the document)."""
    start = F.col("start")
    parent_last = F.get("nodes", start["parent_id"])["last_desc"]
    if rule.mode == "strict":
        parent_last = F.size("nodes") - 1
    return started.withColumn(
        "following",
        F.when(
            start.isNotNull(),
            F.slice("nodes", start["last_desc"] + 2, parent_last - start["last_desc"]),
        ),
    )


def is_sibling(node: Column) -> Column:
    """Needs ``start``."""
    return node["parent_id"] == F.col("start")["parent_id"]


def is_end_tag(node: Column) -> Column:
    """A block tag among the siblings of the start, a header tag below them."""
    return F.when(is_sibling(node), node["tag"].isin(END_TAGS)).otherwise(is_header(node))


def is_end(node: Column, doc_text: Column, rule: SectionRule) -> Column:
    """An end marker by tag and text."""
    return F.coalesce(is_end_tag(node), F.lit(False)) & is_end_text(node_text(doc_text, node), rule)


def end_matches(followed: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``ends``: all end markers after the start, in document order."""
    return followed.withColumn(
        "ends", bound("doc_text", lambda text: F.filter("following", lambda n: is_end(n, text, rule)))
    )


def first_end(followed: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``end``: first marker by (sibling, below before itself, document order), or null.

    In document order a sibling comes before what is below it, so a matching sibling is only taken
    once its subtree has passed without a match.  As soon as the end is certain no text is tested.
    """
    if rule.mode == "strict":
        return _first_strict_end(followed, rule)

    nothing, no = F.lit(None).cast("int"), F.lit(False)

    def state(sibling: Column, last: Column, below: Column, probe: Column) -> Column:
        return F.struct(sibling.alias("sibling"), last.alias("last"), below.alias("below"), probe.alias("probe"))

    def step(found: Column, n: Column, text: Column, probes: Column | None) -> Column:
        settled = F.coalesce(found["below"].isNotNull() | (found["last"] < n["node_id"]), no)
        at, holds = found["probe"], F.lit(True)
        if probes is not None:
            at = _next_probe(probes, at, n)
            holds = _holds_probe(probes, at, n)
        ends = F.coalesce(is_end_tag(n), no) & holds & is_end_text(node_text(text, n), rule)
        sibling = state(n["node_id"], n["last_desc"], found["below"], at)
        below = state(found["sibling"], found["last"], n["node_id"], at)
        passed = state(found["sibling"], found["last"], found["below"], at)
        return F.when(settled, found).when(~ends, passed).when(is_sibling(n), sibling).otherwise(below)

    # a fold copies its state at every step, so it carries numbers of nodes, not nodes
    def fold(text: Column, probes: Column | None = None) -> Column:
        number = F.aggregate(
            "following",
            state(nothing, nothing, nothing, F.lit(0)),
            lambda found, n: step(found, n, text, probes),
            lambda found: F.coalesce(found["below"], found["sibling"]),
        )
        return F.get("nodes", number)

    def search(text: Column) -> Column:
        if not rule.end_probe:
            return fold(text)
        return bound(_places(rule.end_probe), lambda probes: F.when(F.size(probes) > 0, fold(text, probes)))

    return followed.withColumn("end", F.when(F.col("start").isNotNull(), bound("doc_text", search)))


def section_boundaries(parsed: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``start``, ``end`` and ``following`` for every document."""
    return first_end(following_nodes(first_start(parsed, rule), rule), rule)
