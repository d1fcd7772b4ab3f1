"""A whole run: requests in, sections, metadata, failures and counts out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import filings as f
from ..operators.boundaries import ITEM_8, SectionRule
from ..operators.outcomes import filing_outcomes, last_write_wins, one_extraction, run_failed, run_summary
from ..operators.sections import extract_section, section_record
from ..session import shared_root
from ..sinks import files
from ..sources.documents import one_per_address, wanted_documents
from ..sources.registry import company_source
from ..sources.submissions import required_fields, submissions_source

Keep = Callable[[DataFrame, str], DataFrame]


def as_planned(frame: DataFrame, name: str) -> DataFrame:
    """Keep nothing: the step stays part of one lazy plan."""
    return frame


def stored_in(folder: str, *names: str) -> Keep:
    """Write each kept step (or only those named) as a table and go on from there.

    The cut survives lost executors, and readers of the table scan only the columns they use.
    """

    def keep(frame: DataFrame, name: str) -> DataFrame:
        if names and name not in names:
            return frame
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

    return keep


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the one the cluster shares for intermediate tables."""
    return f"{shared_root(spark)}/ledgerloom-{uuid.uuid4().hex}"


def run_name() -> str:
    """A name for a run; later runs sort after earlier ones."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


@dataclass(frozen=True)
class Inputs:
    """Landed tables: ``requests(request_id, ticker, start_year, end_year)``, ``registry(json)`` with or without
    ``document`` and ``http_status``, ``submissions(cik, page, http_status, json)`` and
    ``documents(url, http_status, html)``, best partitioned by ``company_bucket`` and ``filing_year``.
    Listing alone needs no documents."""

    requests: DataFrame
    registry: DataFrame
    submissions: DataFrame
    documents: DataFrame | None


@dataclass(frozen=True)
class Listing:
    """``index``: a row per submission document of an asked company; ``gated``: a status per request; ``filings``: the accepted ones."""

    index: DataFrame
    gated: DataFrame
    filings: DataFrame


def list_filings(inputs: Inputs, keep: Keep = as_planned) -> Listing:
    """Tickers to companies to the annual filings of each accepted request.

    The resolved and the gated requests and the company index are read by several later steps; ``keep`` may store them
    so that the registry and the submission documents are parsed once.
    """
    resolved = keep(f.resolve_tickers(inputs.requests, company_source(inputs.registry)), "resolved")
    wanted = f.wanted_submissions(inputs.submissions, resolved)
    index = keep(f.company_index(required_fields(submissions_source(wanted))), "index")
    gated = keep(f.request_gate(resolved, f.company_summary(index)), "gated")
    filings = keep(f.requested_filings(gated, f.annual_filings(index)), "filings")
    return Listing(index, gated, filings)


def extract_wanted(filings: DataFrame, documents: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """An extraction result for each landed document that is asked for."""
    return extract_section(wanted_documents(documents, filings), rule)


def surviving_filings(outcome: DataFrame, dedup: bool = True) -> DataFrame:
    """What to save, without its text.  ``dedup=False`` keeps every filing of a year."""
    if dedup:
        return last_write_wins(outcome)
    return outcome.filter("status = 'ok'").selectExpr(
        "ticker", "year AS filing_year", "company_name", "accession_number", "url", "content_length"
    ).distinct()


def section_texts(kept: DataFrame, extracted: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """The kept filings' sections with their text.  Texts of other filings are left out before any is moved."""
    wanted = extracted.filter("status = 'ok'").join(kept.select("url").distinct(), "url", "left_semi")
    found = one_extraction(wanted, "content_html").select("url", "status", "content_html")
    return section_record(kept.drop("content_length").join(found, "url"), rule)


def run_batch(
    inputs: Inputs,
    output: str,
    rule: SectionRule = ITEM_8,
    debug: bool = False,
    dedup: bool = True,
    run: str | None = None,
) -> DataFrame:
    """Run everything, write the outputs under ``output`` and return the per-request summary.

    ``run`` names the run in the outputs; repeating a run under its name replaces what it wrote and nothing else.  The
    outputs are committed together, after the last of them is written: a run that dies before leaves nothing to read.
    """
    run = run or run_name()
    keep = stored_in(shared_folder(inputs.requests.sparkSession))
    listing = list_filings(inputs, keep)
    if debug:
        landed = one_per_address(wanted_documents(inputs.documents, listing.filings))
        files.write_raw(listing.filings, landed, f"{output}/raw", run, commit=False)
    extracted = keep(extract_wanted(listing.filings, inputs.documents, rule), "extracted")
    outcome = keep(filing_outcomes(listing.filings, extracted, rule), "outcomes")
    kept = keep(surviving_filings(outcome, dedup), "kept")
    files.write_sections(section_texts(kept, extracted, rule), f"{output}/sections", run, rule, commit=False)
    files.write_metadata(kept, f"{output}/metadata", run, rule, commit=False)
    files.write_failures(outcome, f"{output}/failures", run, rule, commit=False)
    for name in ("sections", "metadata", "failures", *(["raw"] if debug else [])):
        files.commit_run(outcome.sparkSession, f"{output}/{name}", run)
    return run_failed(run_summary(listing.gated, outcome))
