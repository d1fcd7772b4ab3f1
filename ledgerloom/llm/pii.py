"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Patterns find the protected entities (e-mail, IP, card, phone).  The words of the documents that hold an entity are then
weighed by co-occurrence in whole documents: with P(e) the share of all documents that hold entity e and P(e|t) the share
of the documents with term t that do, the disclosure of t is PMI(t, e) / IC(e) = 1 - log P(e|t) / log P(e), which is 1
when t occurs nowhere else.  Terms whose disclosure reaches a threshold are generalised or, higher up, removed wherever
they stand in a document that holds e.

Terms are all words, and of scripts written without spaces also every two and three characters in a row.  Nothing is
asked of a term's length, its distance or how often the entity is seen, so a word that occurs in a single document
discloses every entity there.  Letters inside an entity count as words of its document; added spans lie outside of them.

Defined cases: a null or empty text has no spans but counts as a document; texts of any length are read whole; equal rows
get equal results and count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, text_or_empty

#: In this order where spans start together. Possessive forms and look-behinds only save the retries that cannot match:
#: a run that fails from its first character fails from the others, unless the last match ended inside it (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (sum, i) -> sum + "
    f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9), "
    f"cast(substr({_DIGITS}, -i, 1) as int) + 1 + 10 * (i % 2))) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": r"forall(split(s.value, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
TERM = r"\p{L}[\p{L}\p{M}]*"
#: Letters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
GENERALISE, REMOVE = 0.90, 0.97
#: Tables of terms or entities are broadcast up to this many rows; beyond, Spark picks a shuffled join.
BROADCAST_TERMS = 500_000

SPAN = "struct<start:int,end:int,value:string>"


def spans_of(text: str, pattern: str) -> str:
    """SQL for ``array<struct<start, end, value>>`` of all matches, in code points.

    The text between matches and the matches give running lengths; they are summed in blocks of 256 so that a text
    with very many matches stays near linear.
    """
    quoted = pattern.replace("\\", "\\\\")
    hits = f"regexp_extract_all({text}, '{quoted}', 0)"
    gaps = f"transform(split({text}, '{quoted}', -1), g -> length(g))"
    lengths = "zip_with(gaps, hits, (g, h) -> coalesce(g, 0) + coalesce(length(h), 0))"
    add = "(a, x) -> a + x"
    blocks = f"transform(sequence(0, size(hits) div 256), b -> aggregate(slice(lens, cast(b * 256 + 1 as int), 256), 0, {add}))"
    starts = (
        f"transform(hits, (h, i) -> named_struct('start', gaps[i] + aggregate(slice(sums, 1, i div 256), 0, {add})"
        f" + aggregate(slice(lens, cast(i div 256 as int) * 256 + 1, i % 256), 0, {add}), 'value', h))"
    ).replace("i div 256)", "cast(i div 256 as int))", 1)
    body = (
        f"element_at(transform(array({gaps}), gaps -> element_at(transform(array({lengths}), lens -> "
        f"element_at(transform(array({blocks}), sums -> transform({starts}, s -> named_struct("
        f"'start', cast(s.start as int), 'end', cast(s.start as int) + length(s.value), 'value', s.value))), 1)), 1)), 1)"
    )
    found = f"element_at(transform(array({hits}), hits -> if(size(hits) = 0, cast(array() as array<{SPAN}>), {body})), 1)"
    return found


def base_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` and one array of checked spans per kind."""
    text = documents.select("doc_id", text_or_empty().alias("text"))
    found = text.select("doc_id", "text", *[F.expr(spans_of("text", p)).alias(kind) for kind, p in PATTERNS.items()])
    return found.select("doc_id", "text", *[F.expr(f"filter({kind}, s -> {check})").alias(kind) for kind, check in CHECKS.items()])


def terms_of(text: str) -> str:
    """SQL for the distinct terms of a text."""
    word, letter = TERM.replace("\\", "\\\\"), UNSPACED.replace("\\", "\\\\")
    runs = ", ".join(f"regexp_extract_all({text}, '(?=({letter}{{{n}}}))', 1)" for n in (2, 3))
    return f"array_distinct(transform(concat(regexp_extract_all({text}, '{word}', 0), {runs}), t -> lower(t)))"


def term_spans(text: str) -> str:
    """SQL for ``array<struct<start, end, value>>`` of all places of the terms of a text."""
    cut = (
        "transform(sequence(0, size(c) - {n}), i -> named_struct('start', r.start + i, 'end', r.start + i + {n}, "
        "'value', array_join(slice(c, i + 1, {n}), '')))"
    )
    windows = f"concat({cut.format(n=2)}, if(size(c) < 3, cast(array() as array<{SPAN}>), {cut.format(n=3)}))"
    runs = f"transform({spans_of(text, UNSPACED + '{2,}')}, r -> element_at(transform(array(regexp_extract_all(r.value, '.', 0)), c -> {windows}), 1))"
    return f"concat({spans_of(text, TERM)}, flatten({runs}))"


def _rows(documents: DataFrame, whole: bool = False) -> DataFrame:
    """A row per document: its base spans in order and, where it has any (or always, if ``whole``), its text."""
    arrays = [
        f"transform({kind}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}', 'value', "
        f"if('{kind}' = 'email', lower(s.value), regexp_replace(s.value, '[^0-9.]', ''))))"
        for rank, kind in enumerate(PATTERNS)
    ]
    spans = base_spans(documents).select("doc_id", "text", F.expr(f"array_sort(concat({', '.join(arrays)}))").alias("found"))
    text = F.col("text") if whole else F.when(F.size("found") > 0, F.col("text"))
    return spans.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"), "found")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_TERMS else table


def disclosing_terms(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``row, term, action`` for the terms of a row's document that disclose one of its entities.

    Counts are numbers of documents and run over all of them.  Entities of the same documents have the same counts with
    every term, so they are one group (``n_entity`` documents, told apart by two 64-bit fingerprints of them).
    """
    group = ["n_entity", "h1", "h2"]
    n_documents = rows.count()
    held = rows.select("row", F.explode(F.expr("array_distinct(transform(found, s -> named_struct('kind', s.kind, 'value', s.value)))")).alias("e"))
    held = held.select("row", "e.*")
    entities = stored(
        held.groupBy("kind", "value").agg(
            F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("h2")
        ),
        "pii_entities",
    )
    groups = held.join(_small(entities), ["kind", "value"]).groupBy("row").agg(F.collect_set(F.struct(*group)).alias("groups"))

    terms = rows.filter("size(found) > 0").select("row", F.explode(F.expr(terms_of("text"))).alias("term"))
    every = documents.select(text_or_empty().alias("text")).select(F.explode(F.expr(terms_of("text"))).alias("term"))
    # of more documents than this a term cannot reach the threshold, even where it stands by the entity each time
    p_e = f"least({{n}} / {max(n_documents, 1)}D, 0.5D)"
    most = f"{{n}} / power({p_e}, {1 - GENERALISE:.6f}D) * 1.000001D"
    limit = entities.agg(F.expr(f"max({most.format(n='n_entity')})")).first()[0] or 0.0
    seen = every.groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") <= limit)
    seen = stored(seen.join(terms.select("term").distinct(), "term", "left_semi"), "pii_terms")
    near = terms.join(_small(seen), "term").join(groups, "row")
    near = stored(near.select("row", "term", "n_term", F.inline(F.expr(f"filter(groups, g -> n_term <= {most.format(n='g.n_entity')})"))), "pii_near")

    share = F.count("*") / F.col("n_term")
    disclosure = 1 - F.log(share) / F.log(F.expr(p_e.format(n="n_entity")))
    leaks = near.groupBy("term", "n_term", *group).agg(disclosure.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    leaks = stored(leaks.drop("n_term"), "pii_leaks")
    marked = near.join(_small(leaks), ["term", *group]).groupBy("row", "term")
    return marked.agg(F.when(F.max("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def find(documents: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, found, added``: base spans and the added ones (``start, end, term, action``), a row per document.

    With ``whole`` each row also has its ``text``, so that spans are never matched with a text by its id.
    """
    rows = stored(_rows(documents, whole), "pii_rows")
    marks = stored(disclosing_terms(documents, rows), "pii_marks")
    words = rows.filter("size(found) > 0").select("row", F.explode(F.expr(term_spans("text"))).alias("w"))
    words = words.select("row", F.lower("w.value").alias("term"), "w.start", "w.end")
    added = (
        words.join(_small(marks), ["row", "term"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "term", "action"))).alias("added"))
    )
    joined = rows.join(added, "row", "left")
    apart = F.expr(
        "filter(coalesce(added, array()), a -> not exists(found, s -> s.start < a.end and a.start < s.end))"
    )
    return joined.select("doc_id", *(["text"] if whole else []), "found", apart.alias("added"))


def sanitise(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` with base spans replaced by their kind, added terms removed or generalised.

    Texts are rebuilt from pieces between spans; overlapping spans are cut where the earlier one ends.
    """
    joined = find(documents, whole=True).select(
        "doc_id",
        "text",
        F.expr(
            "array_sort(concat(transform(found, s -> named_struct('start', s.start, 'end', s.end, 'by', concat('[', upper(s.kind), ']'))), "
            "transform(added, a -> named_struct('start', a.start, 'end', a.end, 'by', if(a.action = 'remove', '', '[TERM]')))))"
        ).alias("spans"),
    )
    walk = (
        "aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, s) -> if(s.end <= acc.at, acc, named_struct("
        "'at', s.end, 'out', acc.out || array(substring(text, acc.at + 1, greatest(s.start - acc.at, 0)), s.by))), "
        "acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"
    )
    return joined.select("doc_id", F.expr(f"if(size(spans) = 0, text, {walk})").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in PATTERNS]
    base = "array_join(transform(found, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    every = (
        "array_join(transform(array_sort(concat("
        "transform(found, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind)), "
        "transform(added, a -> named_struct('start', a.start, 'rank', 9, 'end', a.end, 'kind', 'term')))), "
        "s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    )
    return found.select("doc_id", *counts, F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(every).alias("spans"))
