"""Submission documents: one company's filing index as JSON, with parallel arrays per filing field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.filing import listing_status

CORRUPT = "_corrupt"
# what stands before a value that is neither text nor null
_VALUE_MARK = r'[:,\[](?=\s*+[^"\s\]n])(?<=[,\[]|["\s]:)'
WITH_CORRUPT = T.StructType([*S.SUBMISSION.fields, T.StructField(CORRUPT, T.StringType())])


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Landed submission files; the company key is the digits of the file name ``CIK##########.json``."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"CIK(\d+)", 1).alias("cik"),
        F.lit(0).alias("page"),
        F.lit(200).alias("http_status"),
        F.col("value").alias("json"),
    )


def submissions_source(landed: DataFrame) -> DataFrame:
    """``json`` -> typed ``doc`` and ``well_typed``: whether texts stand wherever the document may hold texts only.

    A text that is no such document gives a ``doc`` whose ``_corrupt`` is set, never an exception.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    typed = landed.withColumn("doc", F.from_json("json", WITH_CORRUPT, options))
    return typed.withColumn("well_typed", F.expr(f"{is_plain()} OR {by_kinds()}")).drop("json")


def by_kinds() -> str:
    """SQL condition on the untyped document, which is parsed once, as the variable of an outer lambda."""
    checks = ", ".join(_kind_checks("v", "$", S.SUBMISSION))
    return f"element_at(transform(array(try_parse_json(json)), v -> forall(array({checks}), ok -> ok)), 1)"


def is_plain() -> str:
    """SQL condition that every text of a document with all mandatory fields is one, told without parsing it again.

    Without escapes, quotes only delimit texts, and every value that is neither text nor null stands behind a mark of
    its own.  Where such marks are as many as ``doc`` has lists, objects and numbers, none is left for the place of a
    text.  False tells nothing: an unknown field may hold a number, a text may look like a mark with its value.
    """
    recent, files = "doc.filings.recent", "doc.filings.files"
    fields = S.SUBMISSION.names
    numbers = [f"size({recent}.{n})" for n in S.RECENT.names if n not in S.RECENT_TEXTS]
    known = [
        str(len(fields) - len(S.COMPANY_TEXTS) - len(S.COMPANY_OPTIONAL) + len(S.FILINGS.names) + len(S.RECENT.names)),
        *numbers,
        *[f"size({nested})" for nested in ("doc.addresses", "doc.formerNames", files, files)],  # a file holds a number
    ]
    marks = f"regexp_count(json, r'{_VALUE_MARK}')"
    return f"coalesce(doc.{CORRUPT} IS NULL AND NOT contains(json, r'\\') AND {marks} = {' + '.join(known)}, false)"


def _kind_checks(value: str, path: str, kind: T.DataType, depth: int = 0) -> list[str]:
    """SQL conditions on the untyped value at ``path``: that every text below it is one.

    ``from_json`` turns numbers, lists and objects into text where text is expected; the untyped value tells them
    apart.  Absent and null values are judged by the typed document, and so are numbers.
    """

    def is_one_of(*kinds: str) -> str:
        return f"coalesce(schema_of_variant(variant_get({value}, '{path}')) IN ({', '.join(map(repr, kinds))}), true)"

    def every(container: str, inner: T.DataType) -> list[str]:
        x = f"x{depth}"
        inside = _kind_checks(x, "$", inner, depth + 1)
        return [f"coalesce(forall({container}, {x} -> {' AND '.join(inside)}), true)"] if inside else []

    if isinstance(kind, T.StringType):
        return [is_one_of("STRING", "VOID")]
    if isinstance(kind, T.StructType):
        return [check for f in kind.fields for check in _kind_checks(value, f"{path}.{f.name}", f.dataType, depth)]
    if isinstance(kind, T.MapType):
        return every(f"map_values(try_variant_get({value}, '{path}', 'map<string, variant>'))", kind.valueType)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return [is_one_of("ARRAY<STRING>", "ARRAY<VOID>", "VOID")]
    if isinstance(kind, T.ArrayType):
        return every(f"try_variant_get({value}, '{path}', 'array<variant>')", kind.elementType)
    return []


def _is_complete() -> str:
    """SQL condition: every mandatory field of ``doc`` is there and within its range."""

    def each(array: str, *conditions: str) -> str:
        return f"{array} IS NOT NULL AND forall({array}, x -> " + " AND ".join(conditions) + ")"

    def present(prefix: str, names: list[str]) -> list[str]:
        return [f"{prefix}{name} IS NOT NULL" for name in names]

    def flag(value: str) -> str:
        return f"coalesce({value} BETWEEN 0 AND 255, false)"

    recent, files = "doc.filings.recent", "doc.filings.files"
    checks = [f"doc.{CORRUPT} IS NULL", "well_typed", *present("doc.", S.COMPANY_TEXTS)]
    checks += [flag(f"doc.{n}") for n in S.COMPANY_FLAGS]
    checks += [each(f"doc.{n}", "x IS NOT NULL") for n in ("tickers", "exchanges")]
    checks += [
        each("map_values(doc.addresses)", *present("x.", S.ADDRESS_REQUIRED)),
        each("doc.formerNames", *present("x.", [f"`{n}`" for n in S.FORMER_NAME])),
        each(files, *present("x.", S.FILE_TEXTS), "coalesce(x.filingCount BETWEEN 0 AND 4294967295, false)"),
        each(f"{recent}.size", "coalesce(x >= 0, false)"),
    ]
    checks += [each(f"{recent}.{n}", "x IS NOT NULL") for n in S.RECENT_TEXTS]
    checks += [each(f"{recent}.{n}", flag("x")) for n in S.RECENT_FLAGS]
    return f"coalesce({' AND '.join(checks)}, false)"


def required_fields(parsed: DataFrame) -> DataFrame:
    """``doc_status``: ok, http_error or submissions_parse_error for each submission document."""
    fetched = listing_status(F.col("http_status"))
    return parsed.withColumn(
        "doc_status",
        F.when(fetched != S.OK, fetched)
        .when(F.expr(_is_complete()), S.OK)
        .otherwise(S.PARSE_ERROR),
    )
