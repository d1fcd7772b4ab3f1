"""Requests x companies x filing indexes -> the annual filings to process.

Everything that depends only on a company is computed once per company, before any request is
joined to it: one summary row per company (bounded by the number of distinct years) decides what
becomes of a request and where each filing stands among its company's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.filing import ANNUAL_FORM, cik_pad, document_url, filing_year, in_years
from ..functions.folds import sweep

#: Filings of one company, page and year that meet its requests under one key.
CHUNK = 16


# --- ticker -> company -----------------------------------------------------------------------------
def resolve_tickers(requests: DataFrame, company: DataFrame) -> DataFrame:
    """Adds ``cik`` and ``lookup_status`` to each request.

    Lookup ignores case.  Of several entries for a ticker the first document counts, by name, and in it the first
    index in *string* order ("10" before "2"); entries without a key are passed over.  A ticker that is not found while
    some registry document could not be read fails with that document's status: it may have been in there.
    """
    first = (
        company.filter(F.col("cik_state") != "missing")
        .groupBy(F.upper("ticker").alias("ticker_key"))
        .agg(F.min_by(F.struct("cik", "cik_state"), F.struct("document", "idx")).alias("hit"))
    )
    unread = company.filter(F.col("doc_status") != S.OK).agg(F.min("doc_status")).scalar()
    return (
        requests.withColumn("ticker_key", F.upper("ticker"))
        .join(first, "ticker_key", "left")
        .select(
            *requests.columns,
            cik_pad(F.col("hit.cik")).alias("cik"),
            F.when(F.col("hit").isNull(), F.coalesce(unread, F.lit(S.TICKER_NOT_FOUND)))
            .when(F.col("hit.cik_state") == "invalid", S.INVALID_CIK)
            .otherwise(S.OK)
            .alias("lookup_status"),
        )
        .withColumn("cik", F.when(F.col("lookup_status") == S.OK, F.col("cik")))
    )


def wanted_submissions(submissions: DataFrame, resolved: DataFrame) -> DataFrame:
    """The submission documents of companies that some request asks for, before any is parsed.

    A semi-join on the company key, so documents of a company asked for by many requests are still parsed once.
    """
    return submissions.join(resolved.select("cik").distinct(), "cik", "left_semi")


# --- filing index ----------------------------------------------------------------------------------
def _index_rows(doc: Column) -> Column:
    """Parallel arrays -> array of rows; the accession numbers decide how many there are."""
    recent = doc["filings"]["recent"]
    return F.transform(
        recent["accessionNumber"],
        lambda accession, i: F.struct(
            i.alias("pos"),
            accession.alias("accession_number"),
            F.get(recent["form"], i).alias("form_type"),
            F.get(recent["filingDate"], i).alias("filing_date"),
            F.get(recent["primaryDocument"], i).alias("primary_doc"),
        ),
    )


def _trusted_rows() -> Column:
    """Index rows of a readable document, else null.

    A condition on the value, not a row filter: a filter on ``doc_status`` would be pushed below the
    JSON parsing and repeat it for every field it checks.
    """
    return F.when(F.col("doc_status") == S.OK, _index_rows(F.col("doc")))


def zip_filings(parsed: DataFrame) -> DataFrame:
    """One row per filing of each readable submission document, with ``pos`` in source order."""
    return (
        parsed.withColumn("rows", _trusted_rows())
        .select("cik", "page", F.col("doc.name").alias("company_name"), F.inline_outer("rows"))
        .filter(F.col("pos").isNotNull())
        .withColumn("year", filing_year(F.col("filing_date")))
    )


def is_annual(form: Column) -> Column:
    """Exactly the annual form: no amendments, no other case."""
    return form == ANNUAL_FORM


ANNUAL = ("pos", "accession_number", "form_type", "filing_date", "primary_doc", "year")
ANNUAL_ROWS = (
    "array<struct<pos: int, accession_number: string, form_type: string, filing_date: string, primary_doc: string, "
    "year: int, year_number: int>>"
)


def _numbered(rows: str) -> Column:
    """A page's annual filings by year, each with its number among those of its year in source order.

    A page is one bounded array, so this needs no shuffle; sorted by year, one walk counts.
    """

    def step(state: Column, r: Column, index: Column) -> tuple[dict[str, Column], Column, Column]:
        number = F.when(r["year"].eqNullSafe(state["year"]), state["number"] + 1).otherwise(F.lit(1))
        return {"year": r["year"], "number": number}, F.lit(True), number

    def count(ordered: Column) -> Column:
        numbers = sweep(ordered, {"year": F.lit(None).cast("int"), "number": F.lit(0)}, step)
        row = lambda r, n: F.struct(*[r[c].alias(c) for c in ANNUAL], n.cast("int").alias("year_number"))
        return F.zip_with(ordered, numbers, row)

    by_year = F.sort_array(
        F.transform(rows, lambda r: F.struct(filing_year(r["filing_date"]).alias("year"), *[r[c].alias(c) for c in ANNUAL[:-1]]))
    )
    return F.get(F.transform(F.array(by_year), count), F.lit(0))


def company_index(parsed: DataFrame) -> DataFrame:
    """One row per submission document: its annual filings and whether its index can be trusted.

    ``broken``: a filing without form, or an annual one without a readable date; every request for the
    company then fails.
    """
    rows = parsed.withColumn("rows", _trusted_rows())
    found = rows.withColumn("found", F.filter("rows", lambda r: is_annual(r["form_type"])))
    none = F.array().cast(ANNUAL_ROWS)  # most pages hold no annual filing
    annual = F.when(F.size("found") == 0, none).otherwise(_numbered("found"))
    return found.withColumn("annual", annual).select(
        "cik",
        "page",
        "doc_status",
        F.col("doc.name").alias("company_name"),
        "annual",
        (
            F.exists("rows", lambda r: r["form_type"].isNull())
            | F.exists("annual", lambda r: r["year"].isNull())
        ).alias("broken"),
    )


def annual_filings(index: DataFrame) -> DataFrame:
    """One row per annual filing: ``cik, page, pos, accession_number, ..., year, company_name``."""
    return index.select("cik", "page", "company_name", F.inline_outer("annual")).filter(F.col("pos").isNotNull())


def company_summary(index: DataFrame) -> DataFrame:
    """One row per company: status, and in ``blocks`` the filings of each page and year and whether one of them lacks
    its document name.  A company has few blocks, whatever the number of its filings."""
    flat = index.select(
        "cik",
        "page",
        "doc_status",
        "broken",
        F.explode_outer("annual").alias("filing"),
    )
    per_block = flat.groupBy("cik", "page", F.col("filing.year").alias("year")).agg(
        F.max(F.col("doc_status") == S.HTTP_ERROR).alias("unreachable"),
        F.max((F.col("doc_status") == S.PARSE_ERROR) | F.coalesce("broken", F.lit(False))).alias("broken"),
        F.count("filing").alias("n"),
        F.max(F.col("filing").isNotNull() & F.col("filing.primary_doc").isNull()).alias("incomplete"),
    )
    return per_block.groupBy("cik").agg(
        F.max("unreachable").alias("unreachable"),
        F.max("broken").alias("broken"),
        F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "page", "n", "incomplete"))).alias("blocks"),
    )


# --- requests --------------------------------------------------------------------------------------
def request_gate(resolved: DataFrame, summary: DataFrame) -> DataFrame:
    """``request_status`` for every request, how many later filings its range leaves out, and its company's ``blocks``.

    The checks run in the order the failures would be met.  A filing without document name fails only
    the requests whose range holds it.
    """
    in_range = F.filter("blocks", lambda y: in_years(y["year"], F.col("start_year"), F.col("end_year")))
    later = F.filter("blocks", lambda y: y["year"] > F.col("end_year"))
    # Requests without a company get keys of their own, else they would all meet in one partition.
    key = F.coalesce("cik", F.concat(F.lit("request "), F.col("request_id").cast("string")))
    companies = summary.withColumnRenamed("cik", "key").withColumn("has_submission", F.lit(True))
    joined = resolved.withColumn("key", key).join(companies, "key", "left")
    return joined.select(
        *resolved.columns,
        F.when(F.col("lookup_status") != S.OK, F.col("lookup_status"))
        .when(F.col("has_submission").isNull() | F.col("unreachable"), S.HTTP_ERROR)
        .when(F.col("broken") | F.exists(in_range, lambda y: y["incomplete"]), S.PARSE_ERROR)
        .when(F.size(in_range) == 0, S.NO_FILINGS)
        .otherwise(S.OK)
        .alias("request_status"),
        F.when(
            F.col("end_year").isNotNull(), F.aggregate(later, F.lit(0).cast("bigint"), lambda n, y: n + y["n"])
        )
        .otherwise(F.lit(0).cast("bigint"))
        .alias("n_later"),
        "blocks",
    )


def _ranked_blocks(blocks: Column) -> Column:
    """The company's blocks, newest year first and by page within a year, with the filings ``ahead`` of each."""

    def count(ordered: Column) -> Column:
        ahead = sweep(ordered, {"n": F.lit(0).cast("bigint")}, lambda s, b, _: ({"n": s["n"] + b["n"]}, F.lit(True), s["n"]))
        row = lambda b, n: F.struct((-b["age"]).alias("year"), b["page"].alias("page"), b["n"].alias("n"), n.alias("ahead"))
        return F.zip_with(ordered, ahead, row)

    ordered = F.sort_array(F.transform(blocks, lambda b: F.struct((-b["year"]).alias("age"), b["page"].alias("page"), b["n"].alias("n"))))
    return F.get(F.transform(F.array(ordered), count), F.lit(0))


def requested_filings(gated: DataFrame, filings: DataFrame) -> DataFrame:
    """The filings of every accepted request, with ``filing_rank`` counting from the newest.

    A request first meets its company's blocks, which came along, and asks for the filings of each block in its range in
    chunks: a company with many filings or many requests is many keys.
    """
    accepted = gated.filter(F.col("request_status") == S.OK).select(
        "request_id", F.upper("ticker").alias("ticker"), "cik", "start_year", "end_year", "n_later", _ranked_blocks(F.col("blocks")).alias("blocks")
    )
    in_range = F.filter("blocks", lambda b: in_years(b["year"], F.col("start_year"), F.col("end_year")))
    asked = accepted.select("request_id", "ticker", "cik", "n_later", F.inline(in_range))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))))
    held = filings.withColumn("chunk", F.floor((F.col("year_number") - 1) / CHUNK).cast("int"))
    return asked.join(held, ["cik", "page", "year", "chunk"]).select(
        "request_id",
        (F.col("ahead") + F.col("year_number") - F.col("n_later")).alias("filing_rank"),
        "accession_number",
        "filing_date",
        "form_type",
        "ticker",
        "company_name",
        "cik",
        "primary_doc",
        "year",
        document_url(F.col("cik"), F.col("accession_number"), F.col("primary_doc")).alias("url"),
    )
