"""Shared-folder tables: the cut that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for one table under the one that every executor reaches."""
    return f"{shared_root(spark)}/ledgerloom-llm-{uuid.uuid4().hex}"


#: Spark's own switch to delete a query's shuffle files when the query ends instead of when the driver happens to collect
#: its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and go on from the table; its shuffle files go at once, so that many
    steps use little more disk than one."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often a lambda inside ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inline_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of driver values that needs no Python on the executors."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows
    ]
    table = F.array(*structs) if structs else F.lit(None).cast(f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>>")
    return spark.range(1).select(F.inline(table))
