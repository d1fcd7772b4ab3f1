"""The query list: one entry per operator, each over whole tables.

Queries over built filings use every row of ``documents``; listing queries every row of ``customer``
and ``orders``; the node queries also every row of ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filing as fil
from ..functions import text as txt
from ..operators import boundaries as b
from ..operators import filings as f
from ..operators import nodes as n
from ..operators import outcomes as o
from ..operators import sections as s
from ..operators import spans
from ..sinks import files
from ..sources.documents import attach_documents, one_per_address, wanted_documents
from ..sources.registry import company_source
from ..sources.submissions import required_fields, submissions_source
from . import fixtures as x
from .batch import (
    Listing,
    extract_wanted,
    list_filings,
    section_texts,
    shared_folder,
    stored_in,
)

Query = Callable[[SparkSession, str], DataFrame]

TEXT_PATTERNS = ["[0-9]{3}", "(?i)^the\\s", "(?i)license", "\\.$"]
STRICT = b.SectionRule(mode="strict")
SPAN_PATTERNS = [("[A-Z][a-z]+", "start"), ("[0-9]+", "item8"), ("[,;]", "other")]


# --- shared inputs -----------------------------------------------------------------------------------
def _work(spark: SparkSession) -> str:
    return shared_folder(spark)


def _company(spark: SparkSession, sf: str) -> DataFrame:
    return company_source(x.registry(spark, sf))


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    return required_fields(submissions_source(x.submissions(spark, sf)))


def _zipped(spark: SparkSession, sf: str) -> DataFrame:
    return f.zip_filings(_submissions(spark, sf))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return f.resolve_tickers(x.requests(spark, sf), _company(spark, sf))


def _listing(spark: SparkSession, sf: str, *stored: str) -> Listing:
    """The filing list; ``stored`` names the steps that the query reads more than once, besides the resolved requests."""
    return list_filings(x.listing_inputs(spark, sf), stored_in(_work(spark), "resolved", *stored))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return n.parse_html(x.constructed_documents(spark, sf))


def _parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return n.parse_html(x.scan(spark, sf, "pages").select("page_id", "html"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return s.extract_section(x.constructed_documents(spark, sf))


def _described(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction results with the filing they stand for."""
    return _extracted(spark, sf).withColumns(
        {
            "ticker": F.concat(F.lit("D"), F.col("doc_id").cast("string")),
            "company_name": F.concat(F.lit("Company "), F.col("doc_id").cast("string")),
            "filing_year": (1995 + F.col("doc_id") % 7).cast("int"),
        }
    )


def _outcome(spark: SparkSession, sf: str, *stored: str) -> tuple[Listing, DataFrame]:
    listing = _listing(spark, sf, "index", "filings", *stored)
    extracted = extract_wanted(listing.filings, x.landed_documents(spark, sf))
    return listing, o.filing_outcomes(listing.filings, extracted)


def _bigint(*names: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in names]


# --- sources -----------------------------------------------------------------------------------------
def company_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _company(spark, sf).select("document", "idx", "ticker", "cik", "cik_state", "title", "doc_status")


def submission_documents(spark: SparkSession, sf: str) -> DataFrame:
    recent = F.col("doc.filings.recent")
    return submissions_source(x.submissions(spark, sf)).select(
        F.col("cik"),
        F.col("page").cast("bigint").alias("page"),
        F.col("doc._corrupt").isNotNull().alias("corrupt"),
        F.when(F.col("doc._corrupt").isNull(), F.col("doc.name")).alias("name"),
        F.when(F.col("doc._corrupt").isNull(), F.col("doc.category")).alias("category"),
        F.when(F.col("doc._corrupt").isNull(), F.col("doc.addresses")["mailing"]["city"]).alias("city"),
        F.when(F.col("doc._corrupt").isNull(), F.size(recent["accessionNumber"]).cast("bigint")).alias("n_filings"),
        F.when(F.col("doc._corrupt").isNull(), F.size(recent["primaryDocument"]).cast("bigint")).alias("n_documents"),
        F.when(F.col("doc._corrupt").isNull(), recent["accessionNumber"][0]).alias("first_accession"),
        F.when(
            F.col("doc._corrupt").isNull(),
            F.aggregate(recent["isXBRL"], F.lit(0).cast("bigint"), lambda a, v: a + v),
        ).alias("n_xbrl"),
    )


def submission_status(spark: SparkSession, sf: str) -> DataFrame:
    return _submissions(spark, sf).select("cik", F.col("page").cast("bigint").alias("page"), "doc_status")


def _company_filings(spark: SparkSession, sf: str) -> DataFrame:
    """All annual filings with their address, whether requested or not."""
    return (
        x.order_filings(spark, sf)
        .filter(f.is_annual(F.col("form")))
        .select(
            "accession", fil.document_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url")
        )
    )


def attached_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = x.landed_documents(spark, sf).select(
        "url", "http_status", txt.byte_length(F.col("html")).alias("html_bytes")
    )
    return attach_documents(_company_filings(spark, sf), documents).select(
        "accession", "url", "fetch_status", "html_bytes"
    )


def fetch_results(spark: SparkSession, sf: str) -> DataFrame:
    status = x.document_status(F.col("doc_id"))
    return x.scan(spark, sf, "documents").select(
        "doc_id",
        fil.fetch_status(F.when(F.col("doc_id") % 109 != 1, status)).alias("fetch_status"),
        fil.listing_status(status).alias("listing_status"),
    )


# --- filing list ---------------------------------------------------------------------------------------
def zipped_filings(spark: SparkSession, sf: str) -> DataFrame:
    return _zipped(spark, sf).select(
        "cik", *_bigint("page", "pos"), "accession_number", "form_type", "filing_date", "primary_doc"
    )


def short_arrays(spark: SparkSession, sf: str) -> DataFrame:
    gated = _listing(spark, sf).gated
    return gated.select("request_id", (F.col("request_status") == "submissions_parse_error").alias("parse_error"))


def annual_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _zipped(spark, sf).filter(f.is_annual(F.col("form_type"))).select("accession_number", "form_type")


def filing_years(spark: SparkSession, sf: str) -> DataFrame:
    return x.order_filings(spark, sf).select(
        "accession", "filing_date", fil.filing_year(F.col("filing_date")).cast("bigint").alias("year")
    )


def year_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The annual filings inside the range of each resolved request."""
    annual = _zipped(spark, sf).filter(f.is_annual(F.col("form_type"))).select("cik", "accession_number", "year")
    in_range = fil.in_years(F.col("year"), F.col("start_year"), F.col("end_year"))
    return _resolved(spark, sf).join(annual, "cik").filter(in_range).select("request_id", "accession_number")


def filing_records(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf, "index").filings.select(
        "request_id", "accession_number", "filing_date", "form_type", "ticker", "company_name", "cik", "primary_doc",
        *_bigint("year"),
    )


def padded_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return x.scan(spark, sf, "customer").select(
        "c_custkey", fil.cik_pad(key).alias("cik"), fil.cik_pad(key + 12_345_678_901).alias("long_cik")
    )


def document_urls(spark: SparkSession, sf: str) -> DataFrame:
    return x.order_filings(spark, sf).select(
        "orderkey", fil.document_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url")
    )


def ranked_filings(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf, "index").filings.select("request_id", "accession_number", "filing_rank")


def ticker_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("request_id", "lookup_status", "cik")


def request_submissions(spark: SparkSession, sf: str) -> DataFrame:
    names = x.submission_pages(spark, sf).select("cik", F.col("page").cast("bigint").alias("page"), "http_status")
    return _resolved(spark, sf).filter(F.col("lookup_status") == "ok").join(names, "cik", "left").select(
        "request_id", "cik", "page", fil.listing_status(F.col("http_status")).alias("listing_status")
    )


# --- texts -------------------------------------------------------------------------------------------
def cleaned_texts(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(
        F.lit("\u00a0 \n \u2003"), F.col("text"), F.lit("\na&nbsp;b&#160;c\u00a0 \u3000\t\n")
    )
    return x.scan(spark, sf, "documents").select(
        "doc_id",
        txt.clean_start(wrapped).alias("start_text"),
        txt.clean_end(wrapped).alias("end_text"),
        txt.clean_toc(wrapped).alias("toc_text"),
    )


def matched_texts(spark: SparkSession, sf: str) -> DataFrame:
    return x.scan(spark, sf, "documents").select(
        "doc_id", txt.match_any(F.col("text"), TEXT_PATTERNS).alias("matched")
    )


def matched_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The section's own patterns on headings numbered by part size."""
    heading = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, "Item ").otherwise("ITEM "),
        F.col("p_size").cast("string"),
        F.when(F.col("p_partkey") % 3 == 0, ". Financial Statements ").otherwise(". Changes "),
        F.col("p_name"),
    )
    return x.scan(spark, sf, "part").select(
        "p_partkey",
        b.is_start_text(heading, b.ITEM_8).alias("starts"),
        b.is_end_text(heading, b.ITEM_8).alias("ends"),
    )


def text_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return x.scan(spark, sf, "documents").select("doc_id", txt.byte_length(F.col("text")).alias("n_bytes"))


# --- nodes -------------------------------------------------------------------------------------------
def page_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of each page by tag, those that its markup does not spell out included."""
    nodes = n.html_nodes(_parsed_pages(spark, sf))
    return nodes.filter(F.col("kind") == "element").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def filing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node tables of the built filings, reduced to counts and sizes per document."""
    nodes = n.html_nodes(_parsed(spark, sf))
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("kind") == "element").alias("n_elements"),
        F.count_if(F.col("kind") == "comment").alias("n_comments"),
        F.max("depth").cast("bigint").alias("max_depth"),
        F.sum(F.when(F.col("kind") == "text", F.col("text_len"))).alias("text_bytes"),
    )


def page_header_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Header candidates of each page by tag, bold ones included."""
    candidates = n.header_candidates(_parsed_pages(spark, sf)).select("page_id", F.inline_outer("candidates"))
    return candidates.filter(F.col("tag").isNotNull()).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def filing_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _node_rows(n.header_candidates(_parsed(spark, sf)), "candidates")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every header candidate of each page."""
    return page_header_texts(spark, sf).select("page_id", "tag", "text")


def _candidate_texts() -> Column:
    return n.bound(
        "doc_text",
        lambda text: F.transform(
            "candidates", lambda e: F.struct(e["node_id"].alias("node_id"), e["tag"].alias("tag"), n.node_text(text, e).alias("text"))
        ),
    )


def filing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every header candidate of the built filings, wrappers with all that is below them included."""
    found = n.header_candidates(_parsed(spark, sf))
    texts = _candidate_texts()
    return (
        found.select("doc_id", F.inline_outer(texts))
        .filter(F.col("node_id").isNotNull())
        .select("doc_id", *_bigint("node_id"), "tag", "text")
    )


def page_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every element of each page, implied ones included, with its place in the tree."""
    nodes = n.html_nodes(_parsed_pages(spark, sf)).filter(F.col("kind") == "element")
    return nodes.select("page_id", *_bigint("node_id", "parent_id", "depth"), "tag", "implied")


def page_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every header candidate of each page, bold ones included."""
    found = n.header_candidates(_parsed_pages(spark, sf)).select("page_id", F.inline("candidates"))
    return found.select("page_id", *_bigint("node_id"), "tag")


def page_header_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every header candidate of each page, nested ones included."""
    texts = _candidate_texts()
    return n.header_candidates(_parsed_pages(spark, sf)).select("page_id", F.inline(texts)).select("page_id", *_bigint("node_id"), "tag", "text")


# --- boundaries ----------------------------------------------------------------------------------------
def _node_rows(frame: DataFrame, column: str) -> DataFrame:
    return (
        frame.select("doc_id", F.inline_outer(column))
        .filter(F.col("node_id").isNotNull())
        .select("doc_id", *_bigint("node_id"), "tag")
    )


def _candidate_rows(frame: DataFrame, found: Column) -> DataFrame:
    return _node_rows(frame.withColumn("found", F.transform(found, lambda c: c["node"])), "found")


def start_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _candidate_rows(b.start_matches(_parsed(spark, sf)), F.col("starts"))


def self_links(spark: SparkSession, sf: str) -> DataFrame:
    links = _parsed_pages(spark, sf).select("page_id", F.size(F.filter("nodes", b.is_link)).cast("bigint").alias("n"))
    return links


def toc_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return _candidate_rows(b.candidates(_parsed(spark, sf)), F.filter("candidates", lambda c: c["in_toc"]))


def toc_table_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item numbers of ``part`` in and out of table cells."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    label = F.concat(F.when(key % 4 == 3, "ITEM ").otherwise("Item "), size, F.when(key % 2 == 0, "A.").otherwise(""))
    tail = F.when(key % 5 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise("")
    html = F.when(
        key % 3 == 0, F.concat(F.lit("<p><span>"), label, tail, F.lit("</span></p>"))
    ).otherwise(
        F.concat(F.lit("<table><tr><td><span>"), label, tail, F.lit("</span></td></tr></table>"))
    )
    parts = x.spread(x.scan(spark, sf, "part")).select("p_partkey", html.alias("html"))
    found = b.candidates(n.parse_html(parts))
    return found.select("p_partkey", F.exists("candidates", lambda c: b.is_toc_table_item(c, F.col("doc_text"))).alias("toc_item"))


def outside_toc(spark: SparkSession, sf: str) -> DataFrame:
    started = b.start_matches(_parsed(spark, sf))
    return _candidate_rows(started, F.filter("starts", lambda c: ~b.in_toc(c, F.col("doc_text"))))


def first_starts(spark: SparkSession, sf: str) -> DataFrame:
    return b.first_start(_parsed(spark, sf)).select(
        "doc_id", F.col("start.node_id").cast("bigint").alias("node_id"), F.col("start.tag").alias("tag")
    )


def _followed(spark: SparkSession, sf: str) -> DataFrame:
    return b.following_nodes(b.first_start(_parsed(spark, sf)))


def following_siblings(spark: SparkSession, sf: str) -> DataFrame:
    siblings = F.filter("following", lambda e: b.is_sibling(e) & (e["kind"] == "element"))
    return _node_rows(_followed(spark, sf).withColumn("siblings", siblings), "siblings")


def nested_ends(spark: SparkSession, sf: str) -> DataFrame:
    ended = b.end_matches(_followed(spark, sf))
    return _node_rows(ended.withColumn("nested", F.filter("ends", lambda e: ~b.is_sibling(e))), "nested")


def sibling_ends(spark: SparkSession, sf: str) -> DataFrame:
    ended = b.end_matches(_followed(spark, sf))
    return _node_rows(ended.withColumn("top", F.filter("ends", b.is_sibling)), "top")


def first_ends(spark: SparkSession, sf: str) -> DataFrame:
    return b.section_boundaries(_parsed(spark, sf)).select(
        "doc_id", F.col("end.node_id").cast("bigint").alias("node_id"), F.col("end.tag").alias("tag")
    )


def strict_starts(spark: SparkSession, sf: str) -> DataFrame:
    return b.first_start(_parsed(spark, sf), STRICT).select(
        "doc_id", F.col("start.node_id").cast("bigint").alias("node_id"), F.col("start.tag").alias("tag")
    )


def strict_ends(spark: SparkSession, sf: str) -> DataFrame:
    return b.section_boundaries(_parsed(spark, sf), STRICT).select(
        "doc_id", F.col("end.node_id").cast("bigint").alias("node_id"), F.col("end.tag").alias("tag")
    )


def strict_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = s.extract_section(x.constructed_documents(spark, sf), STRICT)
    return found.select("doc_id", "status", "reason", "content_html", "content_length")


def sliced_sections(spark: SparkSession, sf: str) -> DataFrame:
    return s.slice_section(b.section_boundaries(_parsed(spark, sf))).select("doc_id", "content_html")


def extracted_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("doc_id", "status", "reason", "content_html", "content_length")


def minimum_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select(
        "doc_id", "content_length", F.coalesce(F.col("reason") == "below_min", F.lit(False)).alias("below_min")
    )


def section_records(spark: SparkSession, sf: str) -> DataFrame:
    return s.section_record(_described(spark, sf)).withColumn("filing_year", F.col("filing_year").cast("bigint"))


def metadata_records(spark: SparkSession, sf: str) -> DataFrame:
    records = s.metadata_record(_described(spark, sf).filter(F.col("status") == "ok"))
    return records.drop("extraction_timestamp").withColumn("filing_year", F.col("filing_year").cast("bigint"))


# --- runs --------------------------------------------------------------------------------------------
def request_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).gated.select("request_id", "request_status")


def filing_results(spark: SparkSession, sf: str) -> DataFrame:
    return _outcome(spark, sf)[1].select(
        "request_id", "accession_number", "status", "reason", "content_length", "url"
    )


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    listing, outcome = _outcome(spark, sf, "gated")
    return o.run_summary(listing.gated, outcome)


def failed_runs(spark: SparkSession, sf: str) -> DataFrame:
    listing, outcome = _outcome(spark, sf, "gated")
    return o.run_failed(o.run_summary(listing.gated, outcome)).select("request_id", "all_failed", "run_failed")


RUNS = ("run-1", "run-2")


def _saved(spark: SparkSession, sf: str) -> tuple[str, DataFrame, list[tuple[str, DataFrame]]]:
    """A folder, the extractions, and the outcomes of two runs whose tickers differ but whose years do not."""
    folder = _work(spark)
    keep = stored_in(folder, "resolved", "index", "filings", "extracted", "outcomes")
    listing = list_filings(x.listing_inputs(spark, sf), keep)
    extracted = keep(extract_wanted(listing.filings, x.landed_documents(spark, sf)), "extracted")
    outcome = keep(o.filing_outcomes(listing.filings, extracted), "outcomes")
    return folder, extracted, [(run, outcome.filter(F.crc32("ticker") % 2 == i)) for i, run in enumerate(RUNS)]


def saved_sections(spark: SparkSession, sf: str) -> DataFrame:
    folder, extracted, runs = _saved(spark, sf)
    for run, outcome in runs:
        files.write_sections(section_texts(o.last_write_wins(outcome), extracted), f"{folder}/sections", run)
    schema = (
        "ticker string, filing_year int, company_name string, section_name string, section_title string, "
        "content_html string, file_name string"
    )
    saved = files.latest(spark, f"{folder}/sections", schema, "ticker", "filing_year")
    return saved.withColumn("filing_year", F.col("filing_year").cast("bigint"))


def saved_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The written JSON texts but for their last field, the time."""
    folder, _, runs = _saved(spark, sf)
    for run, outcome in runs:
        files.write_metadata(o.last_write_wins(outcome), f"{folder}/metadata", run)
    schema = "ticker string, filing_year int, record string, file_name string"
    saved = files.latest(spark, f"{folder}/metadata", schema, "ticker", "filing_year")
    timeless = F.regexp_replace("record", ',"extraction_timestamp":"[^"]+"}$', "}")
    return saved.select("file_name", timeless.alias("record"))


def surviving_filings(spark: SparkSession, sf: str) -> DataFrame:
    return o.last_write_wins(_outcome(spark, sf)[1]).select(
        "ticker", *_bigint("filing_year"), "company_name", "accession_number"
    )


def saved_failures(spark: SparkSession, sf: str) -> DataFrame:
    folder, _, runs = _saved(spark, sf)
    for run, outcome in runs:
        files.write_failures(outcome, f"{folder}/failures", run)
    schema = (
        "ticker string, filing_year int, request_id bigint, accession_number string, reason string, failure_text string"
    )
    saved = files.latest(spark, f"{folder}/failures", schema, "ticker", "filing_year", "accession_number")
    return saved.withColumn("filing_year", F.col("filing_year").cast("bigint"))


def saved_raw(spark: SparkSession, sf: str) -> DataFrame:
    folder = _work(spark)
    listing = list_filings(x.listing_inputs(spark, sf), stored_in(folder, "resolved", "index", "filings"))
    for i, run in enumerate(RUNS):
        filings = listing.filings.filter(F.crc32("ticker") % 2 == i)
        landed = one_per_address(wanted_documents(x.landed_documents(spark, sf), filings))
        files.write_raw(filings, landed, f"{folder}/raw", run)
    schema = "ticker string, filing_year int, accession_number string, html string"
    saved = files.latest(spark, f"{folder}/raw", schema, "ticker", "filing_year", "accession_number")
    return saved.withColumn("filing_year", F.col("filing_year").cast("bigint"))


# --- spans -------------------------------------------------------------------------------------------
def _spanned(spark: SparkSession, sf: str) -> DataFrame:
    documents = x.scan(spark, sf, "documents").select("doc_id", F.col("text").alias("html"))
    return spans.regex_spans(documents, SPAN_PATTERNS)


def pattern_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_rows(_spanned(spark, sf)).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "kind"
    )


def annotated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spans.annotate(_spanned(spark, sf)).select("doc_id", "annotated")


QUERIES: dict[str, Query] = {
    "S1_company_source": company_entries,
    "S2_submissions_source": submission_documents,
    "S3_required_fields": submission_status,
    "S4_document_attach": attached_documents,
    "S5_fetch_status": fetch_results,
    "P1_zip_filings": zipped_filings,
    "P2_short_array_check": short_arrays,
    "P3_form_filter": annual_forms,
    "P4_filing_year": filing_years,
    "P5_year_range": year_ranges,
    "P6_filing_record": filing_records,
    "P7_cik_pad": padded_keys,
    "P8_doc_url": document_urls,
    "P9_clean_text": cleaned_texts,
    "P10_match_any": matched_texts,
    "P10_match_any_headings": matched_headings,
    "P11_byte_length": text_bytes,
    "P12_min_size": minimum_sizes,
    "P13_section_record": section_records,
    "P14_metadata_record": metadata_records,
    "H1_html_nodes": page_tag_counts,
    "H1_html_nodes_filings": filing_nodes,
    "H2_header_candidates": page_header_counts,
    "H2_header_candidates_filings": filing_headers,
    "H3_element_text": page_texts,
    "H3_element_text_filings": filing_texts,
    "B1_start_match": start_matches,
    "B2_toc_self_link": self_links,
    "B3_toc_ancestor": toc_ancestors,
    "B4_toc_table_item": toc_table_items,
    "B5_toc_exclude": outside_toc,
    "B6_first_start": first_starts,
    "B7_following_siblings": following_siblings,
    "B8_end_in_descendants": nested_ends,
    "B9_end_sibling_self": sibling_ends,
    "B10_first_end": first_ends,
    "B11_slice": sliced_sections,
    "B12_extract_section": extracted_sections,
    "B6_first_start_strict": strict_starts,
    "B10_first_end_strict": strict_ends,
    "B12_extract_section_strict": strict_sections,
    "J1_ticker_cik": ticker_lookup,
    "J2_company_filings": request_submissions,
    "O1_newest_first": ranked_filings,
    "R1_request_gate": request_statuses,
    "R2_filing_outcome": filing_results,
    "R3_run_summary": summaries,
    "R4_all_failed": failed_runs,
    "K1_section_sink": saved_sections,
    "K2_metadata_sink": saved_metadata,
    "K3_last_write_wins": surviving_filings,
    "K4_failure_sink": saved_failures,
    "K5_raw_sink": saved_raw,
    "D1_regex_spans": pattern_spans,
    "D2_annotate": annotated_documents,
}

#: Whole results over pages for which there is no SQL: tree building is beyond it. Tests hold them against brute force.
PAGE_QUERIES: dict[str, Query] = {
    "H1_html_nodes_pages": page_nodes,
    "H2_header_candidates_pages": page_headers,
    "H3_element_text_pages": page_header_texts,
}
