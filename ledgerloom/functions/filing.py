"""Scalar rules of the filing index: keys, years, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The annual form and the document address.
ANNUAL_FORM = "10-K"
ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data"


def cik_pad(cik: Column) -> Column:
    """Company key with at least ten digits (``lpad`` would cut longer ones)."""
    return F.format_string("%010d", cik)


def filing_year(filing_date: Column) -> Column:
    """Year of the filing date, null when the first four characters are no unsigned number."""
    return F.when(
        F.rlike(filing_date, F.lit("^[+0-9][0-9]{3}")), F.substring(filing_date, 1, 4).try_cast("int")
    )


def in_years(year: Column, start_year: Column, end_year: Column) -> Column:
    """Inclusive range; a null bound is open."""
    return (start_year.isNull() | (year >= start_year)) & (end_year.isNull() | (year <= end_year))


def document_url(cik: Column, accession_number: Column, primary_doc: Column) -> Column:
    return F.concat_ws(
        "/", F.lit(ARCHIVE_ROOT), cik, F.replace(accession_number, F.lit("-"), F.lit("")), primary_doc
    )


def fetch_status(http_status: Column) -> Column:
    """Outcome of fetching one filing document; a document that was never landed counts as not found."""
    return (
        F.when(http_status.between(200, 299), "ok")
        .when(http_status == 403, "rate_limited")
        .when(http_status.isNull() | (http_status == 404), "doc_not_found")
        .otherwise("http_error")
    )


def listing_status(http_status: Column) -> Column:
    """Outcome of fetching a registry or submission document: anything but success is an HTTP error."""
    return F.when(http_status.between(200, 299), "ok").otherwise("http_error")
