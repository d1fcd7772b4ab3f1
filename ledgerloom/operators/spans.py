"""Where patterns occur in a document, and the document with those places highlighted.

Spark has no expression for match positions.  The pieces around the matches (``split``) and the
matches themselves (``regexp_extract_all``) alternate, so positions are running totals of their byte
lengths, which a fold adds up; everything is an expression and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import match_places
from ..functions.text import byte_slice, unicode_pattern
from .nodes import bound

# Highlight kinds with a class of their own, and the document shell around the annotated markup.
KNOWN_KINDS = ["start", "end", "item8", "item9"]
SHELL_HEAD = """<!DOCTYPE html>
<html>
<head>
<style>
.highlight-start { background-color: #FFFF00; }
.highlight-end { background-color: #FFA500; }
.highlight-item8 { background-color: #90EE90; }
.highlight-item9 { background-color: #ADD8E6; }
.highlight-custom { background-color: #FFC0CB; }
</style>
</head>
<body>
"""
SHELL_TAIL = "\n</body>\n</html>"


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise ValueError for a pattern that is no regular expression or matches an empty piece of a sample."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    try:
        compiled = java.compile(unicode_pattern(pattern))
    except IllegalArgumentException as error:
        raise ValueError(f"pattern {pattern!r} does not compile: {error}") from None
    for sample in ("", "Ab 1.,\n<x> -"):
        matcher = compiled.matcher(sample)
        while matcher.find():
            if matcher.start() == matcher.end():
                raise ValueError(f"pattern {pattern!r} can match nothing, so its matches have no extent")


def _spans(places: Column, pattern_no: int, kind: str) -> Column:
    return F.transform(
        places,
        lambda p: F.struct(
            p["start"].alias("start"), F.lit(pattern_no).alias("pattern_no"), p["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def regex_spans(documents: DataFrame, patterns: Sequence[tuple[str, str]], html: str = "html") -> DataFrame:
    """``spans``: every non-overlapping match of each (pattern, kind) as byte offsets, pattern by pattern.

    A pattern that does not compile or that can match nothing is rejected before anything runs.
    """
    for pattern, _ in patterns:
        check_pattern(documents.sparkSession, pattern)
    text, found = F.coalesce(F.col(html), F.lit("")), []
    for at, (pattern, kind) in enumerate(patterns):
        found.append(_spans(match_places(text, unicode_pattern(pattern)), at, kind))
    return documents.select("*", F.concat(*found).alias("spans"))


def span_rows(spanned: DataFrame, html: str = "html") -> DataFrame:
    """One row per match."""
    keys = [c for c in spanned.columns if c not in (html, "spans")]
    # inline alone would let the optimizer infer a filter on its size, push it down and run every pattern twice
    return spanned.select(*keys, F.inline_outer("spans")).filter(F.col("pattern_no").isNotNull())


def annotate(spanned: DataFrame, html: str = "html") -> DataFrame:
    """``annotated``: the document with every span wrapped, in order of its start.

    Each span is preceded by the text since the *previous span's end*, so overlapping spans repeat text.
    """
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = {kind: F.lit(f'<span class="highlight-{kind}" title="Position: ') for kind in [*KNOWN_KINDS, "custom"]}

    def between(raw: Column, start: Column, end: Column) -> Column:
        return F.when(end > start, byte_slice(raw, start.cast("int"), (end - start).cast("int"))).otherwise("")

    def wrap(raw: Column, span: Column, before: Column) -> Column:
        opening = head["custom"]
        for kind in KNOWN_KINDS:
            opening = F.when(span["kind"] == kind, head[kind]).otherwise(opening)
        return F.concat(
            between(raw, before, span["start"]),
            opening,
            span["start"].cast("string"),
            F.lit("-"),
            span["end"].cast("string"),
            F.lit(", Type: "),
            span["kind"],
            F.lit('">'),
            between(raw, span["start"], span["end"]),
            F.lit("</span>"),
        )

    def body(raw: Column, spans: Column, ends: Column) -> Column:
        # each span meets the end of the one before as its neighbour; the text behind the last one has no span
        wrapped = F.transform(spans, lambda span, i: wrap(raw, span, F.get(ends, i)))
        return F.concat(F.array_join(wrapped, ""), between(raw, F.element_at(ends, -1), F.octet_length(raw).cast("bigint")))

    # the document's bytes, the sorted spans and their ends are each worked out once
    zero = F.array(F.lit(0).cast("bigint"))
    shown = bound(
        raw,
        lambda raw: bound(
            F.array_sort("spans"),
            lambda spans: bound(F.concat(zero, F.transform(spans, lambda span: span["end"])), lambda ends: body(raw, spans, ends)),
        ),
    )
    return spanned.withColumn("annotated", F.concat(F.lit(SHELL_HEAD), shown, F.lit(SHELL_TAIL))).drop("spans")
