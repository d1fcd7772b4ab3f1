"""Shapes of the landed JSON documents and the names of the outcome codes."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _lists(element: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(element)) for n in names]


# Field names of one company's submission document.
ADDRESS_OPTIONAL = ["street1", "street2"]
ADDRESS_REQUIRED = ["city", "stateOrCountry", "zipCode", "stateOrCountryDescription"]
FORMER_NAME = ["name", "from", "to"]
FILE_TEXTS = ["name", "filingFrom", "filingTo"]
RECENT_TEXTS = [
    "accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "act", "form", "fileNumber",
    "filmNumber", "items", "primaryDocument", "primaryDocDescription",
]
RECENT_FLAGS = ["isXBRL", "isInlineXBRL"]
COMPANY_TEXTS = [
    "cik", "entityType", "sic", "sicDescription", "name", "category", "fiscalYearEnd", "stateOfIncorporation",
    "stateOfIncorporationDescription", "phone", "flags",
]
COMPANY_FLAGS = ["insiderTransactionForOwnerExists", "insiderTransactionForIssuerExists"]
COMPANY_OPTIONAL = ["ein", "description", "website", "investorWebsite"]

RECENT = T.StructType(
    _lists(T.StringType(), *RECENT_TEXTS)
    + _lists(T.LongType(), "size")
    + _lists(T.IntegerType(), *RECENT_FLAGS)
)
FILINGS = T.StructType(
    [
        T.StructField("recent", RECENT),
        T.StructField(
            "files", T.ArrayType(T.StructType(_strings(*FILE_TEXTS) + [T.StructField("filingCount", T.LongType())]))
        ),
    ]
)
SUBMISSION = T.StructType(
    _strings(*COMPANY_TEXTS, *COMPANY_OPTIONAL)
    + [T.StructField(n, T.IntegerType()) for n in COMPANY_FLAGS]
    + _lists(T.StringType(), "tickers", "exchanges")
    + [
        T.StructField(
            "addresses",
            T.MapType(T.StringType(), T.StructType(_strings(*ADDRESS_OPTIONAL, *ADDRESS_REQUIRED))),
        ),
        T.StructField("formerNames", T.ArrayType(T.StructType(_strings(*FORMER_NAME)))),
        T.StructField("filings", FILINGS),
    ]
)

# Outcome of a request.
OK = "ok"
TICKER_NOT_FOUND = "ticker_not_found"
INVALID_CIK = "invalid_cik"
HTTP_ERROR = "http_error"
PARSE_ERROR = "submissions_parse_error"
REGISTRY_PARSE_ERROR = "registry_parse_error"
NO_FILINGS = "no_filings"
# Outcome of one filing, besides the fetch outcomes of ``functions.filing.fetch_status``.
YEAR_MISSING = "year_missing"
SECTION_NOT_FOUND = "section_not_found"
