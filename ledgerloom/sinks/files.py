"""Outputs of a run, and their latest state over all runs.

Every output is partitioned by filing year, a hash bucket of the ticker and the run.  A run replaces only its own
partitions, so nothing that another run or another ticker wrote is touched, and the number of folders does not grow
with the number of tickers.

What a run wrote counts from the moment it is committed: a manifest beside the data (``_runs``, which readers of the
folder pass over) gets a row when a run begins to write and one when it is done.  ``latest`` reads what stands after all
committed runs: of each key the rows of the run committed last, whatever the runs are called.  ``compact`` writes that
state as a run of its own and retires the runs it is made of.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.boundaries import ITEM_8, SectionRule
from ..operators.sections import metadata_json

BUCKETS = 64
PARTITIONS = ("year", "bucket", "run")
MANIFEST = "run string, state string, at timestamp, noted timestamp"
BEGUN, COMMITTED, RETIRED = "begun", "committed", "retired"


def _file_name(rule: SectionRule, suffix: str) -> Column:
    section = rule.name.replace(" ", "")
    return F.concat(F.upper("ticker"), F.lit("_"), F.col("filing_year").cast("string"), F.lit(f"_{section}{suffix}")).alias("file_name")


def _note(spark: SparkSession, path: str, events: list[tuple[str, str, datetime]]) -> None:
    """Append to the manifest, all events in one file.  ``at`` is the age that orders runs, ``noted`` orders events."""
    now = datetime.now(UTC)
    rows = [(run, state, at, now) for run, state, at in events]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_runs")


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run, at`` of the runs that count: those whose last event is a commit."""
    try:
        events = spark.read.schema(MANIFEST).parquet(f"{path}/_runs")
    except AnalysisException:  # nothing was written here yet
        return spark.createDataFrame([], "run string, at timestamp")
    last = events.groupBy("run").agg(F.max_by(F.struct("state", "at"), F.struct("noted", "state")).alias("last"))
    return last.filter(F.col("last.state") == COMMITTED).select("run", "last.at")


def begin_run(spark: SparkSession, path: str, run: str) -> None:
    """From now until its commit the run does not count, also not with what it wrote before."""
    _note(spark, path, [(run, BEGUN, datetime.now(UTC))])


def commit_run(spark: SparkSession, path: str, run: str) -> None:
    _note(spark, path, [(run, COMMITTED, datetime.now(UTC))])


def _write(frame: DataFrame, path: str, run: str, commit: bool = True) -> None:
    """Rows of one (year, bucket) come together before the write, however they were spread."""
    spark = frame.sparkSession
    begin_run(spark, path, run)
    placed = frame.withColumns(
        {"year": F.col("filing_year"), "bucket": F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).cast("int"), "run": F.lit(run)}
    )
    placed.hint("rebalance", "year", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *PARTITIONS
    ).parquet(path)
    if commit:
        commit_run(spark, path, run)


def latest(spark: SparkSession, path: str, schema: str, *keys: str) -> DataFrame:
    """Of each key the rows of the committed run that is newest; of runs committed at one time the last by name.

    The newest run per key is found on the narrow keys alone.
    """
    return _newest(_committed_rows(spark, path, schema, committed_runs(spark, path)), *keys).drop(*PARTITIONS)


def _committed_rows(spark: SparkSession, path: str, schema: str, runs: DataFrame) -> DataFrame:
    rows = spark.read.schema(f"{schema}, year int, bucket int, run string").option("basePath", path).parquet(path)
    return rows.join(runs, "run")


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    newest = rows.groupBy("year", "bucket", *keys).agg(F.max(F.struct("at", "run")).alias("newest"))
    newest = newest.select("year", "bucket", *keys, F.col("newest.run").alias("run"))
    return rows.join(newest, ["year", "bucket", "run", *keys]).drop("at")


def compact(spark: SparkSession, path: str, schema: str, *keys: str, run: str | None = None) -> str:
    """Write the latest state as one run and retire the runs it is made of; returns its name.

    ``schema`` must name all columns that are to survive.  The new run is as old as the newest it is made of, so a run
    committed meanwhile still counts as newer.  Retired runs' folders are no longer read and may be deleted.
    """
    runs = sorted((r["at"], r["run"]) for r in committed_runs(spark, path).collect())  # a row per run
    if not runs:
        return ""
    run = run or f"compact-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    begin_run(spark, path, run)
    held = spark.createDataFrame([(name, at) for at, name in runs], "run string, at timestamp")
    state = _newest(_committed_rows(spark, path, schema, held), *keys).withColumn("run", F.lit(run))
    state.hint("rebalance", "year", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *PARTITIONS
    ).parquet(path)
    _note(spark, path, [(run, COMMITTED, runs[-1][0]), *((name, RETIRED, at) for at, name in runs if name != run)])
    return run


def write_sections(sections: DataFrame, path: str, run: str, rule: SectionRule = ITEM_8, commit: bool = True) -> None:
    """Section text, one row per (ticker, year)."""
    _write(sections.withColumn("ticker", F.upper("ticker")).select("*", _file_name(rule, ".html")), path, run, commit)


def write_metadata(kept: DataFrame, path: str, run: str, rule: SectionRule = ITEM_8, commit: bool = True) -> None:
    """``record``: the JSON description of every section, all seven fields.  Needs no section text."""
    named = kept.withColumn("ticker", F.upper("ticker"))
    _write(named.select("ticker", "filing_year", metadata_json(rule).alias("record"), _file_name(rule, "_meta.json")), path, run, commit)


def write_failures(outcomes: DataFrame, path: str, run: str, rule: SectionRule = ITEM_8, commit: bool = True) -> None:
    """Extraction failures only, all of them, keyed by accession number."""
    failed = outcomes.filter(F.col("status") == S.SECTION_NOT_FOUND).select(
        "ticker",
        F.col("year").alias("filing_year"),
        "request_id",
        "accession_number",
        "reason",
        "error",
        "url",
        F.concat(
            F.lit(f"Failed to extract {rule.name} for "),
            F.concat_ws(" ", "ticker", F.col("year").cast("string")),
            F.lit(": "),
            "error",
            F.lit("\nURL: "),
            "url",
            F.lit("\n"),
        ).alias("failure_text"),
    )
    _write(failed, path, run, commit)


def write_raw(filings: DataFrame, documents: DataFrame, path: str, run: str, commit: bool = True) -> None:
    """Markup of every fetched filing, whether or not a section is found in it; one row per filing.

    ``documents``: one row per address.
    """
    named = filings.select("ticker", F.col("year").alias("filing_year"), "accession_number", "url").distinct()
    raw = named.join(documents.filter(F.col("http_status").between(200, 299)).select("url", "html"), "url")
    _write(raw, path, run, commit)
