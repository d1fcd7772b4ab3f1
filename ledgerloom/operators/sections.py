"""Cut the section between its boundaries and describe it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_length, byte_slice
from .boundaries import ITEM_8, SectionRule, is_above, is_sibling, section_boundaries
from .nodes import bound, markup_tokens, node_html, parse_html


def slice_section(bounded: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """``content_html``: what lies between start and end, both excluded.

    Elements are written as markup, loose text as it reads (not escaped), comments are left out.
    An end marker nested in a sibling does not stop the slice: it runs to the end of the parent.  In strict mode the
    sibling is cut there and closed again, and what follows the start's parent belongs to the section too.
    """
    end = F.col("end")
    if rule.mode == "strict":
        return _slice_strictly(bounded)
    stop = F.when(is_sibling(end), end["node_id"]).otherwise(F.lit(2**31 - 1))
    pieces = F.filter(
        "following", lambda n: is_sibling(n) & (n["node_id"] < stop) & (n["kind"] != "comment")
    )

    def write(n: Column, text: Column, tokens: Column) -> Column:
        return F.when(n["kind"] == "element", node_html(F.col("doc_html"), tokens, n)).otherwise(
            byte_slice(text, n["text_start"], n["text_len"])
        )

    texts = bound(
        "doc_text",
        lambda text: bound(markup_tokens(F.col("doc_html")), lambda tokens: F.transform(pieces, lambda n: write(n, text, tokens))),
    )
    return bounded.withColumn("content_html", F.when(end.isNotNull(), F.array_join(texts, "")))


def _slice_strictly(bounded: DataFrame) -> DataFrame:
    start, end = F.col("start"), F.col("end")
    # what stands under an element around the start, and is no such element itself
    loose = lambda n: (n["parent_id"] < start["node_id"]) & (n["node_id"] < end["node_id"]) & (n["kind"] != "comment")
    pieces = F.filter("following", loose)

    def write(n: Column, text: Column, tokens: Column) -> Column:
        own_text = byte_slice(text, n["text_start"], n["text_len"])
        return F.when(n["kind"] != "element", own_text).otherwise(node_html(F.col("doc_html"), tokens, n, end))

    texts = bound(
        "doc_text",
        lambda text: bound(markup_tokens(F.col("doc_html")), lambda tokens: F.transform(pieces, lambda n: write(n, text, tokens))),
    )
    half_open = F.filter("following", lambda n: is_above(n, end))
    closing = F.transform(F.reverse(half_open), lambda n: F.concat(F.lit("</"), n["tag"], F.lit(">")))
    content = F.concat(F.array_join(texts, ""), F.array_join(closing, ""))
    return bounded.withColumn("content_html", F.when(end.isNotNull(), content))


def section_reason(rule: SectionRule = ITEM_8) -> Column:
    """Why there is no section: no_start, no_end or below_min; null when there is one."""
    return (
        F.when(F.col("start").isNull(), "no_start")
        .when(F.col("end").isNull(), "no_end")
        .when(F.col("content_length") < rule.min_bytes, "below_min")
    )


def extract_section(documents: DataFrame, rule: SectionRule = ITEM_8, html: str = "html") -> DataFrame:
    """Documents -> one row each with ``status``, ``reason``, ``content_html`` and ``content_length``.

    No shuffle anywhere; the markup is parsed once.  ``content_html`` is kept only for sections that
    passed the size check, ``content_length`` for everything that was cut.

    The result is handed on through a one-element ``inline``.  A later filter on it cannot be moved
    below a generator; without that the optimizer would copy the whole search into the filter.
    """
    sliced = slice_section(section_boundaries(parse_html(documents, html), rule), rule)
    measured = sliced.withColumn("content_length", byte_length(F.col("content_html")))
    keys = [c for c in documents.columns if c != html]
    result = F.struct(
        F.when(F.col("reason").isNull(), "ok").otherwise("section_not_found").alias("status"),
        "reason",
        F.when(F.col("reason").isNull(), F.col("content_html")).alias("content_html"),
        "content_length",
    )
    return measured.withColumn("reason", section_reason(rule)).select(*keys, F.inline(F.array(result)))


def section_record(extracted: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """Found sections as records; expects ``ticker``, ``company_name`` and ``filing_year`` alongside."""
    return extracted.filter(F.col("status") == "ok").select(
        F.lit(rule.name).alias("section_name"),
        F.lit(rule.title).alias("section_title"),
        "content_html",
        "filing_year",
        "company_name",
        "ticker",
    )


def _metadata_fields(rule: SectionRule) -> list[Column]:
    """The seven fields that describe a section; its length is known from the extraction, its text is not read."""
    return [
        F.col("ticker"),
        F.col("company_name"),
        F.col("filing_year"),
        F.lit(rule.name).alias("section_name"),
        F.lit(rule.title).alias("section_title"),
        F.col("content_length"),
        F.date_format(
            F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
        ).alias("extraction_timestamp"),
    ]


def metadata_record(kept: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    return kept.select(*_metadata_fields(rule))


def metadata_json(rule: SectionRule = ITEM_8) -> Column:
    """The same fields as one JSON text."""
    return F.to_json(F.struct(*_metadata_fields(rule)))


