"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. Quality classifier: documents it rejects go.
2. N-gram Jaccard join (five words, 0.8): one document of each group stays.
3. Benchmark decontamination: contaminated documents go.
4. Mixing to target weights: each source gives what its budget allows, no document twice.
5. Sharding by exact bytes: adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, mixing, ngram_join, quality_classifier, sharding
from ledgerloom.llm.tables import stored
from ledgerloom.session import ship_package

#: Part of the tokens of stage 4's input that the mix asks for; sources that are rich beyond their weight are cut back.
MIX_FRACTION = 0.9


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of the best grade is too low go.

    A null or empty text is judged by its shape alone; rows that repeat an id or a text are judged each; a null id
    is judged like any other; without labels of two grades all rows stay; an empty table stays empty.
    """
    ship_package(spark)
    return quality_classifier.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts stays, that of the smallest id, null last.

    Rows that share an id and differ in text are documents of their own; rows that repeat both are one; texts without
    words are similar to nothing, so only their repetitions go; an empty table stays empty.
    """
    ship_package(spark)
    return ngram_join.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with too many words of benchmark windows go.

    A null or empty text has no words and stays; rows are told apart by id and text, null ids included, so repeated
    rows go or stay together; an empty benchmark or table changes nothing.
    """
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives the prefix of its seeded order that its budget allows, no document twice.

    A null domain, language or source is a branch of its own; a text without words costs nothing and goes in where its
    turn comes; of repeated rows as many stay as were taken; an empty table stays empty.
    """
    return mixing.mix_documents(docs, fraction=MIX_FRACTION, max_epochs=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, dealt to shards of near-equal bytes, with ``size, text_crc32, law, shard, slot, grown_shard``.

    A null text has no bytes and counts one; every row, repeated or without an id, gets a slot of its own; an empty table
    stays empty.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
