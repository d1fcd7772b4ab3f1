"""The corpus pipeline, stage by stage on each stage's own input, and the registered SQL."""

import re
from collections import Counter

import duckdb
import pytest
from brute import spaced_words
from pyspark.sql import functions as F
from test_models import classes

import corpus_pipeline
from ledgerloom.llm import mixing, quality_classifier
from ledgerloom.llm.queries import ORACLES, QUERIES
from ledgerloom.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), name))
    return [t.collect() for t in tables]


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_classifier_stage(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert ids(stages[1]) == Counter(r.doc_id for r in judged if r.kept) and 0 < len(stages[1]) < len(stages[0])


def test_join_stage(stages):
    want = {c for _, c in classes([(r.doc_id, r.text) for r in stages[1]], 5, 80).values()}
    assert ids(stages[2]) == Counter(want)


def test_decontamination_stage(spark, sf_dir, stages):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    grams = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(13, len(w))
        grams.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    clean = []
    for r in stages[2]:
        w = words(r.text)
        hit = {i + k for n, held in grams.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in held for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    assert ids(stages[3]) == ids(clean)


def test_mixing_stage(stages):
    domain = lambda s: "web" if s < 8 else "books" if s < 14 else "reference"
    leaf = lambda r: (domain(int(r.source[3:])), r.lang, r.source)
    supply, given, longest = Counter(), Counter(), max(len(spaced_words(r.text)) for r in stages[3])
    for r in stages[3]:
        supply[leaf(r)] += len(spaced_words(r.text))
    for r in stages[4]:
        given[leaf(r)] += len(spaced_words(r.text))
    wanted = mixing.budgets(dict(supply), mixing.TARGETS, corpus_pipeline.MIX_FRACTION * sum(supply.values()), 1.0)
    assert not ids(stages[4]) - ids(stages[3]) and len(stages[4]) < len(stages[3])
    assert all(-1e-6 <= wanted[p] - given[p] <= longest for p in wanted)


def test_sharding_stage(stages):
    assert ids(stages[5]) == ids(stages[4])
    sizes = Counter()
    for r in stages[5]:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in stages[5])


def test_columns_and_run(spark, sf_dir, stages):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[:5])
    assert Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(
        (r.doc_id, r.shard, r.slot) for r in stages[5]
    )


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    words = "some plain words of a document that stands by itself number"
    rows = [(i, f"{words} {i} {' '.join(f'v{i}w{k}' for k in range(30))}", "en", f"src{i % 5}", 1) for i in range(40)]
    rows += [(7, "another text of an id that is taken " * 3, "de", "src1", 2), rows[3], rows[3]]
    return rows + [(None, None, None, None, None), (None, "", None, None, None), (None, f"{words} without an id", "en", "src2", 3), (90, "x " * 200_000, "fr", None, 4)]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    """Nulls, empty and long texts, repeated ids and rows, clashing names, no rows at all."""
    run = dict(corpus_pipeline.STAGES)[stage]
    clashing = {"key": F.lit(1), "row": F.lit("r"), "count": F.lit(2), "component_id": F.lit(3), "words": F.lit(4), "_n": F.lit(5)}
    docs = stored(spark.createDataFrame(odd_rows(), ODD).withColumns(clashing), "odd")
    out = run(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns if stage != "sharding" else set(docs.columns) <= set(out.columns)
    kept, given = Counter(map(tuple, out.select(*docs.columns).collect())), Counter(map(tuple, docs.collect()))
    assert not kept - given
    names = {(r[0], r[1]) for r in kept}
    if stage == "ngram_jaccard":
        assert max(kept.values()) == 1
        assert {(7, r[1]) for r in given if r[0] == 7} <= names and {(None, None), (None, "")} <= names
    if stage in ("decontamination", "sharding"):
        assert kept == given
    assert run(spark, docs.filter("false"), sf_dir).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame, expected = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    order = sorted(frame.columns)
    assert order == sorted(expected.columns)
    got = sorted(str([r[c] for c in order]) for r in frame.collect())
    assert got == sorted(str([r[expected.columns.index(c)] for c in order]) for r in expected.fetchall())
