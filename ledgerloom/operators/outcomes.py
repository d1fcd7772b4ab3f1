"""What became of every filing and every request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.filing import fetch_status
from .boundaries import ITEM_8, SectionRule


def error_text(rule: SectionRule = ITEM_8) -> Column:
    """Message of an extraction failure; the two boundary reasons share one wording (fixed texts)."""
    return F.when(
        F.col("reason").isin("no_start", "no_end"),
        F.format_string(
            f"Section not found: Could not find valid start/end boundaries for {rule.name} in DOM for %s-%d",
            "ticker",
            "year",
        ),
    ).when(
        F.col("reason") == "below_min",
        F.format_string(
            f"Section not found: {rule.name} found but size %d bytes is less than minimum {rule.min_bytes} bytes",
            "content_length",
        ),
    )


def one_extraction(extracted: DataFrame, *carried: str) -> DataFrame:
    """One row per address, however often it landed: a fetched document before a failed one, a found section before
    none, then by length and content.  ``carried`` columns (the section text) come along only where asked for."""
    narrow = extracted.select(
        "url", "http_status", "status", "reason", "content_length", F.xxhash64("content_html").alias("version"), *carried
    )
    unfetched = F.coalesce(fetch_status(F.col("http_status")) != S.OK, F.lit(True))
    order = F.struct(unfetched, F.col("status") != S.OK, "http_status", "reason", "content_length", "version")
    rest = F.struct("http_status", "status", "reason", "content_length", *carried)
    return narrow.groupBy("url").agg(F.min_by(rest, order).alias("kept")).select("url", "kept.*")


def filing_outcomes(filings: DataFrame, extracted: DataFrame, rule: SectionRule = ITEM_8) -> DataFrame:
    """One row per requested filing: ``status``, ``reason``, ``content_length``, ``error``.

    One row per document address is chosen first (``one_extraction``), so this is one narrow left join; the section
    text itself is not carried.  Nothing here can fail a batch.
    """
    found = one_extraction(extracted).select(
        "url", "http_status", F.col("status").alias("section_status"), "reason", "content_length"
    )
    fetched = fetch_status(F.col("http_status"))
    status = (
        F.when(fetched != S.OK, fetched)
        .when(F.col("year").isNull(), S.YEAR_MISSING)
        .otherwise(F.col("section_status"))
    )
    return (
        filings.join(found, "url", "left")
        .withColumn("status", status)
        .withColumn("reason", F.when(F.col("status") == S.SECTION_NOT_FOUND, F.col("reason")))
        .withColumn("content_length", F.when(fetched == S.OK, F.col("content_length")))
        .withColumn("error", error_text(rule))
        .drop("section_status", "http_status")
    )


def run_summary(gated: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Success and failure counts of every request, accepted or not."""
    counts = outcomes.groupBy("request_id").agg(
        F.count_if(F.col("status") == S.OK).alias("success_count"),
        F.count_if(F.col("status") != S.OK).alias("failure_count"),
    )
    return gated.select("request_id", "request_status").join(counts, "request_id", "left").na.fill(
        0, ["success_count", "failure_count"]
    )


def run_failed(summary: DataFrame) -> DataFrame:
    """``all_failed``: filings were tried and none worked; ``run_failed`` adds the rejected requests."""
    all_failed = (F.col("success_count") == 0) & (F.col("failure_count") > 0)
    return summary.withColumn("all_failed", all_failed).withColumn(
        "run_failed", all_failed | (F.col("request_status") != S.OK)
    )


def last_write_wins(outcomes: DataFrame) -> DataFrame:
    """The one filing whose section stays for each (ticker, year): the last success in processing order.

    ``max_by`` combines before the shuffle, so no task gathers a whole ticker.
    """
    return (
        outcomes.filter(F.col("status") == S.OK)
        .groupBy("ticker", F.col("year").alias("filing_year"))
        .agg(
            F.max_by(
                F.struct("company_name", "accession_number", "url", "content_length"), F.struct("request_id", "filing_rank")
            ).alias("last")
        )
        .select("ticker", "filing_year", "last.*")
    )
