"""Company registry: JSON objects ``{index: {ticker, cik_str, ...}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.filing import listing_status


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Landed registry files, one JSON object per file; a registry may be split over many files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document"), F.col("value").alias("json"))


def company_source(landed: DataFrame) -> DataFrame:
    """Registry documents -> one row per entry: ``document, idx, ticker, cik, cik_state, title, doc_status``.

    ``landed(json)`` may bring ``document``, a name that orders the documents, and ``http_status``.  A document that
    was not fetched or cannot be read gives one row without ``idx`` whose ``doc_status`` tells so.  Of equal keys in
    a document the last counts.

    The entries are read untyped: ``cik_state`` tells a missing key from a value that is no
    unsigned integer, because a missing one is passed over while a bad one fails the lookup.
    A ticker that is not a string reads as empty; an entry without one is dropped.
    """
    document = F.col("document") if "document" in landed.columns else F.lit("")
    fetched = listing_status(F.col("http_status")) if "http_status" in landed.columns else F.lit(S.OK)
    parsed = landed.select(
        document.alias("document"), fetched.alias("fetched"), F.from_json("json", "map<string, variant>").alias("registry")
    )
    rows = parsed.select(
        "document",
        F.when(F.col("fetched") != S.OK, S.HTTP_ERROR)
        .when(F.col("registry").isNull(), S.REGISTRY_PARSE_ERROR)
        .otherwise(S.OK)
        .alias("doc_status"),
        # posexplode keeps the order of equal keys
        F.posexplode_outer(F.when(F.col("fetched") == S.OK, F.map_entries("registry"))).alias("at", "entry"),
    )
    last = rows.filter("at is not null").groupBy("document", F.col("entry.key").alias("idx")).agg(F.max("at").alias("at"))
    kept = rows.join(last.select("document", "at"), ["document", "at"], "left_semi").select(
        "document", F.col("entry.key").alias("idx"), F.col("entry.value").alias("value")
    )
    ticker, cik = F.expr("variant_get(value, '$.ticker')"), F.expr("variant_get(value, '$.cik_str')")
    number = F.try_variant_get("value", "$.cik_str", "bigint")
    valid = (F.schema_of_variant(cik) == "BIGINT") & (number >= 0)
    entries = kept.filter(ticker.isNotNull()).select(
        "document",
        "idx",
        F.when(
            F.schema_of_variant(ticker) == "STRING", F.try_variant_get("value", "$.ticker", "string")
        )
        .otherwise("")
        .alias("ticker"),
        F.when(valid, number).alias("cik"),
        F.when(cik.isNull(), "missing").when(valid, "ok").otherwise("invalid").alias("cik_state"),
        F.try_variant_get("value", "$.title", "string").alias("title"),
        F.lit(S.OK).alias("doc_status"),  # said, so that a search for failed documents passes entries over
    )
    failed = rows.filter(F.col("doc_status") != S.OK).select("document", "doc_status")
    return entries.unionByName(failed, allowMissingColumns=True)
