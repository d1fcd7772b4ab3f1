"""Landed filing documents: ``document(url, http_status, html)``.

A large table should be partitioned by ``company_bucket`` and ``filing_year`` (see ``document_place``); where it has
these columns they take part in the joins, so that only the partitions of wanted filings are read.  Landed by
``land_documents`` it is also bucketed by address: joins and choices by address then read markup where it lies and
shuffle none of it, if the session lets a part of the join keys decide (``CO_PARTITION`` set to false).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filing import fetch_status

COMPANY_BUCKETS = 256
PLACE = ("company_bucket", "filing_year")
#: Buckets by address in each partition.
ADDRESS_BUCKETS = 32
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def document_place(filings: DataFrame) -> DataFrame:
    """``filings(cik, year, ...)`` with the partition columns of its documents."""
    return filings.withColumns(
        {"company_bucket": F.pmod(F.xxhash64("cik"), F.lit(COMPANY_BUCKETS)).cast("int"), "filing_year": F.col("year").cast("int")}
    )


def land_documents(documents: DataFrame, table: str, path: str, buckets: int = ADDRESS_BUCKETS) -> DataFrame:
    """Write documents that have their place as a table, partitioned by it and bucketed by address, and return it.

    Rows of one bucket come together before the write, so a partition gets one file per bucket.
    """
    dealt = documents.repartition(buckets, "url")
    written = dealt.write.partitionBy(*PLACE).bucketBy(buckets, "url").sortBy("url").format("parquet").option("path", path)
    written.mode("overwrite").saveAsTable(table)
    return documents.sparkSession.table(table)


def landed_documents(spark: SparkSession, table: str, path: str, schema: str, buckets: int = ADDRESS_BUCKETS) -> DataFrame:
    """What ``land_documents`` wrote, for a session whose catalogue does not know the table yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}, company_bucket INT, filing_year INT) USING parquet "
        f"PARTITIONED BY (company_bucket, filing_year) CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def _keys(documents: DataFrame) -> list[str]:
    return [c for c in PLACE if c in documents.columns] + ["url"]


def one_per_address(documents: DataFrame) -> DataFrame:
    """One row per address, whatever landed twice: a successful fetch before a failed one, then by content.

    Select only what is needed first; all columns but the address take part in the choice.
    """
    keys = _keys(documents)
    rest = [c for c in documents.columns if c not in keys]
    failed = F.coalesce(fetch_status(F.col("http_status")) != "ok", F.lit(True))
    chosen = documents.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(failed, *rest)).alias("chosen"))
    return chosen.select(*keys, "chosen.*")


def attach_documents(filings: DataFrame, documents: DataFrame) -> DataFrame:
    """Filings left-joined to their landed document by ``url``, with ``fetch_status``.

    Select from ``documents`` only what the result needs: the markup is by far the widest column.
    """
    keys = _keys(documents)
    placed = document_place(filings) if len(keys) > 1 else filings
    joined = placed.join(one_per_address(documents), keys, "left").drop(*PLACE)
    return joined.withColumn("fetch_status", fetch_status(F.col("http_status")))


def wanted_documents(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """Each landed document that some filing asks for; ``html`` only where the fetch succeeded.

    A semi-join, so a document asked for by many requests is still parsed once.  Partitions of other companies and
    years are pruned at run time; markup is shuffled only if the list of addresses is too large to broadcast (the
    optimizer decides by size).
    """
    keys = _keys(documents)
    asked = (document_place(filings) if len(keys) > 1 else filings).select(*keys).distinct()
    fetched = fetch_status(F.col("http_status")) == "ok"
    return documents.join(asked, keys, "left_semi").select(
        "url", "http_status", F.when(fetched, F.col("html")).alias("html")
    )
