"""Outcomes, sinks, whole runs and spans."""

import json
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.html_tree import nest, operation
from ledgerloom.operators import spans
from ledgerloom.operators.boundaries import SectionRule
from ledgerloom.operators.outcomes import filing_outcomes, last_write_wins, run_failed, run_summary
from ledgerloom.operators.sections import metadata_record
from ledgerloom.plans import fixtures
from ledgerloom.plans.batch import run_batch, section_texts
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sinks import files


def test_whole_run_writes_everything(spark, sf_dir, tmp_path):
    inputs = fixtures.all_inputs(spark, sf_dir)
    summary = run_batch(inputs, str(tmp_path), debug=True).collect()
    expected = QUERIES["R3_run_summary"](spark, sf_dir).collect()
    assert {(r.request_id, r.success_count, r.failure_count) for r in summary} == {
        (r.request_id, r.success_count, r.failure_count) for r in expected
    }
    sections = spark.read.parquet(f"{tmp_path}/sections")
    saved = sections.count()
    assert saved == QUERIES["K3_last_write_wins"](spark, sf_dir).count() > 0
    assert sections.filter("octet_length(content_html) < 1000").count() == 0
    records = [json.loads(r.record) for r in spark.read.parquet(f"{tmp_path}/metadata").collect()]
    assert len(records) == saved and all(
        set(r) == {"ticker", "company_name", "filing_year", "section_name", "section_title", "content_length", "extraction_timestamp"}
        for r in records
    )
    assert datetime.fromisoformat(records[0]["extraction_timestamp"]).utcoffset().total_seconds() == 0
    lengths = {(r.ticker, r.filing_year): len(r.content_html.encode()) for r in sections.collect()}
    assert {(r["ticker"], r["filing_year"]): r["content_length"] for r in records} == lengths
    assert spark.read.parquet(f"{tmp_path}/failures").filter("reason IS NULL").count() == 0
    assert spark.read.parquet(f"{tmp_path}/raw").count() == QUERIES["K5_raw_sink"](spark, sf_dir).count()
    # a second run has partitions of its own; together they read as one
    run_batch(inputs, str(tmp_path), run="9")
    run_batch(inputs, str(tmp_path), run="9")
    assert spark.read.parquet(f"{tmp_path}/sections").count() == 2 * saved
    assert files.latest(spark, f"{tmp_path}/sections", "ticker string, filing_year int, content_html string", "ticker", "filing_year").count() == saved


def outcome_rows(spark):
    return spark.createDataFrame(
        [
            (1, 1, "AA", 2021, "n", "x-1", "u1", "ok"),
            (1, 2, "AA", 2021, "n", "x-2", "u2", "ok"),
            (1, 3, "AA", 2021, "n", "x-3", "u3", "section_not_found"),
            (1, 4, "AA", 2020, "n", "x-4", "u4", "ok"),
            (2, 1, "BB", 2020, "n", "y-1", "u5", "doc_not_found"),
        ],
        "request_id long, filing_rank long, ticker string, year int, company_name string, accession_number string, "
        "url string, status string",
    ).withColumn("content_length", F.lit(9))


def test_the_last_success_of_a_year_stays(spark):
    kept = last_write_wins(outcome_rows(spark)).collect()
    assert {(r.ticker, r.filing_year, r.accession_number) for r in kept} == {("AA", 2021, "x-2"), ("AA", 2020, "x-4")}


def test_summary_and_failed_runs(spark):
    gated = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "no_filings")], "request_id long, request_status string")
    rows = run_failed(run_summary(gated, outcome_rows(spark))).orderBy("request_id").collect()
    assert [(r.success_count, r.failure_count, r.all_failed, r.run_failed) for r in rows] == [
        (3, 1, False, False), (0, 1, True, True), (0, 0, False, True),
    ]


KEPT = "ticker string, filing_year int, company_name string, accession_number string, url string, content_length long"


def test_runs_leave_each_other_alone(spark, tmp_path):
    """Two tickers in one year, and the same ticker again: nothing of another run or ticker goes."""
    failure = "ticker string, year int, request_id int, accession_number string, reason string, error string, url string, status string"

    def failed(ticker, accession, reason):
        return spark.createDataFrame([(ticker, 2020, 1, accession, reason, "e", "u", "section_not_found")], failure)

    def section(ticker, text):
        return spark.createDataFrame(
            [("Item 7A", "t", text, 2020, "c", ticker)],
            "section_name string, section_title string, content_html string, filing_year int, company_name string, ticker string",
        )

    path = str(tmp_path / "failures")
    files.write_failures(failed("AA", "1", "no_start"), path, "run-1")
    files.write_failures(failed("BB", "2", "no_end"), path, "run-2")
    files.write_failures(failed("AA", "1", "below_min"), path, "run-3")
    rows = files.latest(spark, path, "ticker string, filing_year int, accession_number string, reason string", "ticker", "accession_number")
    assert {(r.ticker, r.filing_year, r.reason) for r in rows.collect()} == {("BB", 2020, "no_end"), ("AA", 2020, "below_min")}

    rule, path = SectionRule(name="Item 7A"), str(tmp_path / "sections")
    files.write_sections(section("aa", "old"), path, "run-1", rule)
    files.write_sections(section("bb", "other"), path, "run-2", rule)
    files.write_sections(section("aa", "new"), path, "run-3", rule)
    rows = files.latest(spark, path, "ticker string, filing_year int, content_html string, file_name string", "ticker", "filing_year")
    assert {(r.content_html, r.file_name) for r in rows.collect()} == {("other", "BB_2020_Item7A.html"), ("new", "AA_2020_Item7A.html")}

    documents = spark.createDataFrame([("u1", 200, "m1"), ("u2", 200, "m2")], "url string, http_status int, html string")
    path = str(tmp_path / "raw")
    for run, ticker, url in (("run-1", "AA", "u1"), ("run-2", "BB", "u2")):
        filings = spark.createDataFrame([(ticker, 2020, ticker, url)], "ticker string, year int, accession_number string, url string")
        files.write_raw(filings, documents, path, run)
    assert {r.html for r in spark.read.parquet(path).collect()} == {"m1", "m2"}


SECTIONS = "section_name string, section_title string, content_html string, filing_year int, company_name string, ticker string"
READ = "ticker string, filing_year int, content_html string, file_name string"


def sections(spark, *texts):
    return spark.createDataFrame([("Item 8", "t", text, 2020, "c", ticker) for ticker, text in texts], SECTIONS)


def standing(spark, path, *keys):
    return {r.ticker: r.content_html for r in files.latest(spark, path, READ, "ticker", "filing_year").collect()}


def test_runs_count_in_the_order_of_their_commits(spark, tmp_path):
    """Ten runs whose names do not sort by age."""
    path = str(tmp_path / "sections")
    assert files.committed_runs(spark, path).count() == 0
    for i in range(1, 11):
        files.write_sections(sections(spark, ("AA", f"text {i}"), (f"B{i}", "own")), path, f"run-{i}")
    got = standing(spark, path)
    assert got["AA"] == "text 10" and len(got) == 11
    # an old run that is repeated is the newest
    files.write_sections(sections(spark, ("AA", "again")), path, "run-2")
    got = standing(spark, path)
    assert got["AA"] == "again" and "B2" in got, "partitions that the repetition does not write stay"


def test_half_written_runs_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "sections")
    files.write_sections(sections(spark, ("AA", "old")), path, "run-1")
    files.write_sections(sections(spark, ("AA", "half"), ("BB", "half")), path, "run-2", commit=False)
    assert standing(spark, path) == {"AA": "old"}
    files.commit_run(spark, path, "run-2")
    assert standing(spark, path) == {"AA": "half", "BB": "half"}
    files.begin_run(spark, path, "run-2")  # repeated, and died
    assert standing(spark, path) == {"AA": "old"}


def test_compaction_keeps_the_state_and_retires_runs(spark, tmp_path):
    path = str(tmp_path / "sections")
    for i in range(4):
        files.write_sections(sections(spark, ("AA", f"text {i}"), (f"B{i}", f"own {i}")), path, f"run-{i}")
    files.write_sections(sections(spark, ("AA", "unseen")), path, "open", commit=False)
    before = standing(spark, path)
    schema = "section_name string, section_title string, content_html string, filing_year int, company_name string, ticker string, file_name string"
    name = files.compact(spark, path, schema, "ticker", "filing_year")
    assert [r.run for r in files.committed_runs(spark, path).collect()] == [name]
    assert standing(spark, path) == before and len(before) == 5
    rows = spark.read.parquet(path).filter(F.col("run") == name)
    assert rows.count() == 5 and rows.filter("company_name = 'c' AND section_title = 't'").count() == 5
    # what is committed later is newer, and a run that began before the compaction still may be
    files.commit_run(spark, path, "open")
    assert standing(spark, path) == before | {"AA": "unseen"}
    files.compact(spark, path, schema, "ticker", "filing_year")
    assert standing(spark, path) == before | {"AA": "unseen"}
    assert files.compact(spark, str(tmp_path / "nothing"), schema, "ticker") == ""


def test_only_kept_texts_are_moved(spark):
    """Texts of filings that another one replaces are left out before the shuffle that gathers texts."""
    kept = spark.createDataFrame([("AA", 2020, "c", "x-1", "u1", 4)], KEPT)
    extracted = spark.createDataFrame(
        [(f"u{i}", 200, "ok", None, "text", 4) for i in range(3)],
        "url string, http_status int, status string, reason string, content_html string, content_length long",
    )
    frame = section_texts(kept, extracted)
    assert [r.content_html for r in frame.collect()] == ["text"]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan.index("Aggregate [url")
    assert "LeftSemi" in plan[aggregate:]


def test_spans_and_highlights_need_no_python(spark):
    frame = spark.createDataFrame([(1, "ab 12")], "doc_id int, html string")
    plan = spans.annotate(spans.regex_spans(frame, [("[a-z]+", "start")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_metadata_needs_no_section_text(spark):
    kept = spark.createDataFrame([("AA", 2020, "c", "x-1", "u", 4)], KEPT)
    (row,) = metadata_record(kept).collect()
    assert row.content_length == 4 and row.section_name == "Item 8"


def test_an_address_that_landed_twice_gives_one_outcome(spark):
    filings = spark.createDataFrame([(1, "AA", 2020, "x-1", "u")], "request_id int, ticker string, year int, accession_number string, url string")
    extracted = spark.createDataFrame(
        [("u", 404, "section_not_found", "no_start", None, None), ("u", 200, "ok", None, "text", 4), ("u", 200, "ok", None, "text", 4)],
        "url string, http_status int, status string, reason string, content_html string, content_length long",
    )
    assert [(r.status, r.content_length) for r in filing_outcomes(filings, extracted).collect()] == [("ok", 4)]


@pytest.mark.parametrize("pattern", ["[0-9]*", "x?", "(", r"\b", "a|"])
def test_patterns_without_extent_are_rejected(spark, pattern):
    frame = spark.createDataFrame([(1, "ab12c")], "doc_id int, html string")
    with pytest.raises(ValueError, match="pattern"):
        spans.regex_spans(frame, [(pattern, "start")])


def test_each_pattern_runs_once_for_hits_and_once_for_gaps(spark):
    frame = spark.createDataFrame([(1, "ab12c")], "doc_id int, html string")
    rows = spans.span_rows(spans.regex_spans(frame, [("[a-z]+", "start"), ("[0-9]+", "end")]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("split(") == 2


def seconds(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def test_annotation_grows_with_the_document(spark):
    def annotated(n):
        frame = spark.createDataFrame([(1, "ab 12, " * n)], "doc_id int, html string")
        return lambda: spans.annotate(spans.regex_spans(frame, [("[a-z]+", "start"), ("[0-9]+", "end")])).write.format("noop").mode("overwrite").save()

    annotated(1000)()
    small, large = seconds(annotated(20_000)), seconds(annotated(40_000))
    assert large < 3 * small + 2


def test_tree_building_grows_with_the_document():
    def tree(n):
        marks = ["<p", "", "</p"] * n + ["<table"] + ["<p", "", "</p"] * n + ["</table"]
        return lambda: nest([operation(m) for m in marks], ["" if m else "x" for m in marks], [""] * len(marks))

    small, large = seconds(tree(20_000)), seconds(tree(40_000))
    assert large < 3 * small + 1


TEXTS = ["", "Item 8 and ITEM 9 é Item", "ééé Item8 x", "no match", "ItemItem", "x Item"]


@pytest.mark.parametrize("patterns", [[("Item", "start")], [("I", "item9"), ("Item", "custom"), (r"\d", "end")]])
def test_spans_and_highlights_equal_a_plain_loop(spark, patterns):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, html string").repartition(3)
    spanned = spans.regex_spans(frame, patterns)
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in spanned.collect()}
    pages = {r.doc_id: r.annotated for r in spans.annotate(spanned).collect()}
    for doc_id, text in enumerate(TEXTS):
        raw, expected = text.encode(), []
        for pattern, kind in patterns:
            expected += [
                (len(text[: m.start()].encode()), len(text[: m.end()].encode()), kind)
                for m in re.finditer(pattern, text)
            ]
        assert got[doc_id] == expected
        out, at = b"", 0
        for start, end, kind in sorted(expected, key=lambda s: s[0]):
            name = kind if kind in ("start", "end", "item8", "item9") else "custom"
            out += raw[at:start] if start > at else b""
            out += f'<span class="highlight-{name}" title="Position: {start}-{end}, Type: {kind}">'.encode()
            out += raw[start:end] + b"</span>"
            at = end
        out += raw[at:]
        assert pages[doc_id].split("<body>\n")[1] == out.decode() + "\n</body>\n</html>"


def test_hot_keys_keep_plans_bounded(spark, sf_dir):
    """Partial aggregation before every shuffle that groups by ticker or request, and no cross joins."""
    for name in ("R3_run_summary", "K3_last_write_wins", "P6_filing_record"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = QUERIES["K3_last_write_wins"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_ranking_adds_no_shuffle(spark, sf_dir):
    plan = QUERIES["O1_newest_first"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["P11_byte_length"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    pages = QUERIES["H3_element_text"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in pages


def test_missing_shared_folder_is_reported():
    from ledgerloom.session import shared_root

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Cluster)
