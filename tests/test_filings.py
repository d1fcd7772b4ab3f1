"""Registry lookup, submission checks, request gate and ranking on small hand-made inputs."""

import json
from copy import deepcopy

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.filing import cik_pad, filing_year
from ledgerloom.operators import filings as f
from ledgerloom.plans import fixtures
from ledgerloom.plans.batch import Inputs, list_filings
from ledgerloom.sources.documents import document_place, one_per_address, wanted_documents
from ledgerloom.sources.registry import company_source, read_registry
from ledgerloom.sources.submissions import WITH_CORRUPT, by_kinds, is_plain, read_submissions, required_fields, submissions_source


def submission(rows, **changes):
    """``rows``: (accession, date, form, document)."""
    n = len(rows)
    recent = {k: [""] * n for k in ("reportDate", "acceptanceDateTime", "act", "fileNumber", "filmNumber", "items",
                                    "primaryDocDescription")}
    recent |= {
        "accessionNumber": [r[0] for r in rows],
        "filingDate": [r[1] for r in rows],
        "form": [r[2] for r in rows],
        "primaryDocument": [r[3] for r in rows],
        "size": [1] * n,
        "isXBRL": [0] * n,
        "isInlineXBRL": [1] * n,
    }
    texts = ("cik entityType sic sicDescription category fiscalYearEnd stateOfIncorporation "
             "stateOfIncorporationDescription phone flags").split()  # fmt: skip
    doc = dict.fromkeys(texts, "x") | {
        "name": "Acme",
        "insiderTransactionForOwnerExists": 0,
        "insiderTransactionForIssuerExists": 1,
        "tickers": ["A"],
        "exchanges": [],
        "ein": None,
        "addresses": {"mailing": {"street1": None, "city": "c", "stateOrCountry": "s", "zipCode": "z",
                                  "stateOrCountryDescription": "d"}},
        "formerNames": [],
        "filings": {"recent": recent, "files": [{"name": "f", "filingCount": 1, "filingFrom": "a", "filingTo": "b"}]},
        "unknownKey": [1, 2],
    }
    return doc | changes


K = [("a-1", "2020-05-01", "10-K", "d1"), ("a-2", "2021-05-01", "10-K", "d2"), ("a-3", "2021-02-01", "10-K", "d3"),
     ("a-4", "2021-01-01", "10-K/A", "d4"), ("a-5", "2019-01-01", "10-k", "d5")]


def landed(spark, *documents, cik="0000000001", http=200):
    rows = [(cik, page, http, d if isinstance(d, str) else json.dumps(d)) for page, d in enumerate(documents)]
    return spark.createDataFrame(rows, "cik string, page int, http_status int, json string")


def edited(path, value):
    doc = deepcopy(submission(K))
    *above, last = path
    at = doc
    for step in above:
        at = at[step]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return doc


@pytest.mark.parametrize(
    ("document", "status"),
    [
        (submission(K), "ok"),
        (submission([]), "ok"),
        (edited(["ein"], KeyError), "ok"),
        (edited(["category"], KeyError), "submissions_parse_error"),
        (edited(["category"], None), "submissions_parse_error"),
        (edited(["tickers"], [None]), "submissions_parse_error"),
        (edited(["insiderTransactionForOwnerExists"], 256), "submissions_parse_error"),
        (edited(["insiderTransactionForOwnerExists"], "no"), "submissions_parse_error"),
        (edited(["addresses", "mailing", "city"], None), "submissions_parse_error"),
        (edited(["addresses", "mailing", "street1"], KeyError), "ok"),
        (edited(["addresses", "mailing"], None), "submissions_parse_error"),
        (edited(["addresses"], {}), "ok"),
        (edited(["formerNames"], [{"name": "n", "from": "f"}]), "submissions_parse_error"),
        (edited(["filings", "files"], KeyError), "submissions_parse_error"),
        # a number, list or object where a text belongs, however deep
        (edited(["addresses", "mailing", "city"], 5), "submissions_parse_error"),
        (edited(["addresses", "mailing", "street1"], 5), "submissions_parse_error"),
        (edited(["addresses", "business"], {"city": "c", "stateOrCountry": "s", "zipCode": 1, "stateOrCountryDescription": "d"}), "submissions_parse_error"),
        (edited(["addresses"], []), "submissions_parse_error"),
        (edited(["formerNames"], [{"name": "n", "from": "f", "to": "t"}, {"name": "n", "from": 1990, "to": "t"}]), "submissions_parse_error"),
        (edited(["formerNames"], [{"name": "n", "from": "f", "to": {"y": 1}}]), "submissions_parse_error"),
        (edited(["filings", "files", 0, "name"], 5), "submissions_parse_error"),
        (edited(["filings", "files", 0, "filingFrom"], True), "submissions_parse_error"),
        (edited(["filings", "recent", "act"], ["", "", 3, "", ""]), "submissions_parse_error"),
        (edited(["category"], ["Large"]), "submissions_parse_error"),
        (edited(["description"], 7), "submissions_parse_error"),
        (edited(["unknown"], 7), "ok"),
        (edited(["filings", "files", 0, "filingCount"], -1), "submissions_parse_error"),
        (edited(["filings", "files", 0], None), "submissions_parse_error"),
        (edited(["filings", "recent"], KeyError), "submissions_parse_error"),
        (edited(["filings", "recent", "act"], KeyError), "submissions_parse_error"),
        (edited(["filings", "recent", "size"], [-1] * 5), "submissions_parse_error"),
        (edited(["filings", "recent", "isXBRL"], [0, 0, None, 0, 0]), "submissions_parse_error"),
        ("", "submissions_parse_error"),
        ("[]", "submissions_parse_error"),
        ("{", "submissions_parse_error"),
    ],
)
def test_required_fields(spark, document, status):
    (row,) = required_fields(submissions_source(landed(spark, document))).collect()
    assert row.doc_status == status


def _only_known(**changes):
    doc = submission(K) | changes
    del doc["unknownKey"]
    return doc


def test_plain_documents_are_told_without_the_untyped_parse(spark):
    """Counting settles documents of texts in known fields, and never otherwise than the kinds of the untyped values."""
    plain = [_only_known(), _only_known(lei=None, owner="06"), _only_known(formerNames=[{"name": "n", "from": "1990", "to": "1"}] * 2),
             json.dumps(_only_known(), indent=1), json.dumps(_only_known(), separators=(",", ":")).replace('":', '" :')]
    bare = [5, -1.5, True, [], {}, ["x"], {"y": "x"}, [5, "x"], ["x", None, 5], [["x"]], [None, 5]]
    places = [["sic"], ["ein"], ["tickers"], ["addresses", "mailing", "street1"], ["addresses", "mailing", "city"],
              ["filings", "recent", "act"], ["filings", "recent", "form", 0], ["filings", "recent", "form", 4],
              ["filings", "files", 0, "name"]]
    odd = [edited(place, value) for place in places for value in bare if not (place == ["tickers"] and value == [])]
    fooling = []  # one number too few beside one too many
    for doc in odd:
        for at, value in ((["insiderTransactionForOwnerExists"], None), (["insiderTransactionForOwnerExists"], "1"), (["filings", "recent", "size"], [1, 1, 1, 1, "1"])):
            copy = deepcopy(doc)
            del copy["unknownKey"]
            *above, last = at
            inner = copy
            for step in above:
                inner = inner[step]
            inner[last] = value
            fooling.append(copy)
    odd += [{k: v for k, v in doc.items() if k != "unknownKey"} for doc in odd]
    escaped = [json.dumps(_only_known(sic=7)).replace('"sic"', '"\\u0073ic"'), json.dumps(_only_known(sic=7)) + ' "x"', "[" + json.dumps(_only_known()) + "]"]
    for documents, settled in ((plain, True), (odd + fooling + escaped, False)):
        typed = landed(spark, *documents).withColumn("doc", F.from_json("json", WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        told = required_fields(submissions_source(landed(spark, *documents))).select("page", "doc_status")
        by_kind = required_fields(typed.withColumn("well_typed", F.expr(by_kinds()))).select("page", F.col("doc_status").alias("expected"))
        rows = told.join(by_kind, "page").join(typed.select("page", F.expr(is_plain()).alias("plain")), "page").collect()
        assert len(rows) == len(documents)
        assert [r for r in rows if r.doc_status != r.expected] == []
        if settled:
            assert all(r.plain and r.doc_status == "ok" for r in rows)


def test_registry_entries(spark):
    registry = {
        "2": {"ticker": "aa", "cik_str": 2},
        "10": {"ticker": "AA", "cik_str": 10, "title": "Ten"},
        "3": {"ticker": "BB"},
        "4": {"ticker": "bb", "cik_str": 4},
        "5": {"ticker": "CC", "cik_str": None},
        "6": {"ticker": "CC", "cik_str": 6},
        "7": {"ticker": "DD", "cik_str": -1},
        "8": {"cik_str": 8},
        "9": {"ticker": 5, "cik_str": 9},
    }
    company = company_source(spark.createDataFrame([(json.dumps(registry),), ("{}",), ("oops",)], "json string"))
    assert [r.doc_status for r in company.filter("idx IS NULL").collect()] == ["registry_parse_error"]
    company = company.filter("idx IS NOT NULL")
    assert {r.idx: (r.ticker, r.cik, r.cik_state) for r in company.collect()} == {
        "2": ("aa", 2, "ok"), "10": ("AA", 10, "ok"), "3": ("BB", None, "missing"), "4": ("bb", 4, "ok"),
        "5": ("CC", None, "invalid"), "6": ("CC", 6, "ok"), "7": ("DD", None, "invalid"), "9": ("", 9, "ok"),
    }
    requests = spark.createDataFrame([(i, t) for i, t in enumerate(["Aa", "BB", "cc", "dd", "ee"])], "request_id long, ticker string")
    found = {r.ticker: (r.lookup_status, r.cik) for r in f.resolve_tickers(requests, company).collect()}
    assert found == {
        "Aa": ("ok", "0000000010"), "BB": ("ok", "0000000004"), "cc": ("invalid_cik", None),
        "dd": ("invalid_cik", None), "ee": ("ticker_not_found", None),
    }


def listing(spark, submissions, *bounds):
    requests = spark.createDataFrame(
        [(i, "aa", start, end) for i, (start, end) in enumerate(bounds)],
        "request_id long, ticker string, start_year int, end_year int",
    )
    registry = spark.createDataFrame([('{"0": {"ticker": "AA", "cik_str": 1}}',)], "json string")
    return list_filings(Inputs(requests, registry, submissions, None))


def ranked(found):
    rows = found.filings.orderBy("request_id", "filing_rank").collect()
    return [(r.request_id, r.filing_rank, r.accession_number) for r in rows]


def statuses(found):
    return [r.request_status for r in found.gated.orderBy("request_id").collect()]


def test_newest_first_within_the_range_and_stable(spark):
    found = listing(spark, landed(spark, submission(K)), (None, None), (2021, None), (None, 2020), (2022, None), (2021, 2020))
    assert statuses(found) == ["ok", "ok", "ok", "no_filings", "no_filings"]
    assert ranked(found) == [
        (0, 1, "a-2"), (0, 2, "a-3"), (0, 3, "a-1"), (1, 1, "a-2"), (1, 2, "a-3"), (2, 1, "a-1"),
    ]
    row = found.filings.filter("request_id = 2").first()
    assert (row.ticker, row.company_name, row.cik, row.year) == ("AA", "Acme", "0000000001", 2020)
    assert row.url == "https://www.sec.gov/Archives/edgar/data/0000000001/a1/d1"


def test_only_documents_of_asked_companies_are_read(spark):
    pages = landed(spark, submission(K)).unionAll(landed(spark, submission(K), cik="0000000002"))
    found = listing(spark, pages, (None, None), (2021, None))
    assert {r.cik for r in found.index.collect()} == {"0000000001"}
    assert statuses(found) == ["ok", "ok"] and len(ranked(found)) == 5


def test_only_asked_submissions_and_filings_are_made(spark, sf_dir):
    """The semi-joins stand below the making of the markup, so what nobody asks for is not written."""
    resolved = spark.createDataFrame([(1, "0000000010"), (2, "0000000010"), (3, None)], "request_id long, cik string")
    made = fixtures.submissions(spark, sf_dir)
    wanted = f.wanted_submissions(made, resolved)
    assert sorted(wanted.collect()) == sorted(made.filter("cik = '0000000010'").collect()) != []
    plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")
    landings = fixtures.landed_documents(spark, sf_dir)
    urls = sorted(r.url for r in landings.select("url").distinct().collect())[:5]
    filings = landings.filter(F.col("url").isin(urls)).select("url", F.col("filing_year").alias("year"))
    filings = filings.withColumn("cik", F.regexp_extract("url", "data/([0-9]+)/", 1))
    documents = wanted_documents(landings, filings)
    assert sorted({r.url for r in documents.collect()}) == urls
    assert documents.count() == landings.filter(F.col("url").isin(urls)).count()
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("LeftSemi")


def test_index_spread_over_pages_is_ranked_as_one(spark):
    pages = [submission([(f"p{p}-{i}", f"{2000 + (i + p) % 3}-01-01", "10-K", "d") for i in range(7)]) for p in range(3)]
    found = listing(spark, landed(spark, *pages), (None, None), (None, 2001), (2001, 2001))
    source = [(2000 + (i + p) % 3, f"p{p}-{i}") for p in range(3) for i in range(7)]
    expected = []
    for request, keep in enumerate([lambda y: True, lambda y: y <= 2001, lambda y: y == 2001]):
        kept = sorted((x for x in source if keep(x[0])), key=lambda x: -x[0])
        expected += [(request, rank, name) for rank, (_, name) in enumerate(kept, 1)]
    assert ranked(found) == expected


def short(name, rows=K):
    doc = submission(rows)
    doc["filings"]["recent"][name] = doc["filings"]["recent"][name][:-1]
    return doc


LAST_2019 = [*K, ("a-6", "2019-01-01", "10-K", "d6")]
PARSE = "submissions_parse_error"


@pytest.mark.parametrize(
    ("document", "expected"),
    [
        # form is needed for every filing, date and document only for the annual ones
        (short("form"), [PARSE, PARSE]),
        (short("filingDate"), ["ok", "ok"]),
        (short("filingDate", LAST_2019), [PARSE, PARSE]),
        (short("primaryDocument"), ["ok", "ok"]),
        # a missing document fails only the requests whose range holds the filing
        (short("primaryDocument", LAST_2019), [PARSE, "ok"]),
        (submission([*K, ("a-6", "n/a", "10-K", "d")]), [PARSE, PARSE]),
        (submission([*K, ("a-6", "n/a", "8-K", "d")]), ["ok", "ok"]),
        # extra entries in a longer array are never looked at
        (short("accessionNumber", LAST_2019), ["ok", "ok"]),
    ],
)
def test_short_arrays_fail_the_request(spark, document, expected):
    found = listing(spark, landed(spark, document), (None, None), (2020, None))
    assert statuses(found) == expected
    assert {r[0] for r in ranked(found)} == {i for i, s in enumerate(expected) if s == "ok"}


def test_unreachable_company_is_an_http_error(spark):
    assert statuses(listing(spark, landed(spark, submission(K), http=503), (None, None))) == ["http_error"]
    assert statuses(listing(spark, landed(spark, submission(K), cik="0000000002"), (None, None))) == ["http_error"]


def test_scalar_rules(spark):
    rows = spark.createDataFrame([("2021-01-01",), ("+202-x",), ("202",), ("20a1-",), ("",), (None,), ("٢٠٢١-01",)], "d string")
    assert [r.y for r in rows.select(filing_year(F.col("d")).alias("y")).collect()] == [2021, 202, None, None, None, None, None]
    wide = spark.range(1).select(cik_pad(F.lit(7)).alias("a"), cik_pad(F.lit(12345678901)).alias("b")).first()
    assert tuple(wide) == ("0000000007", "12345678901")


def test_landed_json_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "CIK0000000001.json").write_text(json.dumps(submission(K), indent=1))
    (tmp_path / "r.json").write_text('{"0":\n {"ticker": "AA", "cik_str": 1}}')
    (row,) = required_fields(submissions_source(read_submissions(spark, str(tmp_path / "s")))).collect()
    assert (row.cik, row.doc_status, row.doc.name) == ("0000000001", "ok", "Acme")
    assert [r.cik for r in company_source(read_registry(spark, str(tmp_path / "r.json"))).collect()] == [1]


def test_numbering_in_a_page_is_linear(spark):
    """Doubling a page's filings doubles the time."""
    import time

    def seconds(n):
        doc = submission([(f"x-{i}", f"{1990 + i % 20}-01-01", "10-K", f"d{i}") for i in range(n)])
        frame = landed(spark, doc)
        start = time.perf_counter()
        ((size,),) = f.company_index(required_fields(submissions_source(frame))).select(F.size("annual")).collect()
        assert size == n
        return time.perf_counter() - start

    seconds(100)
    small, large = min(seconds(10_000) for _ in range(3)), min(seconds(20_000) for _ in range(3))
    assert large < 3 * small + 0.5


def test_a_hot_company_is_spread_over_keys(spark):
    """300 requests for one company with 1200 filings in one page: no task gets twice the median."""
    filings = [(f"x-{i}", f"{2001 + i % 3}-01-01", "10-K", f"d{i}") for i in range(1200)]
    requests = spark.createDataFrame([(i, "AA", None, None) for i in range(300)], "request_id long, ticker string, start_year int, end_year int")
    index = f.company_index(required_fields(submissions_source(landed(spark, submission(filings), cik="0000000007"))))
    resolved = requests.selectExpr("*", "'0000000007' AS cik", "'ok' AS lookup_status")
    gated = f.request_gate(resolved, f.company_summary(index))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for key, value in zip(held, ("false", "8", "-1")):
            spark.conf.set(key, value)
        found = f.requested_filings(gated, f.annual_filings(index))
        rows = found.groupBy(F.spark_partition_id()).count().collect()
        ranks = found.filter("request_id = 7").orderBy("filing_rank").collect()
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    sizes = sorted(r["count"] for r in rows)
    assert sum(sizes) == 300 * 1200 and len(sizes) == 8
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    wanted = sorted(range(1200), key=lambda i: (-(2001 + i % 3), i))
    assert [(r.filing_rank, r.accession_number) for r in ranks] == [(k, f"x-{i}") for k, i in enumerate(wanted, 1)]


def test_a_hot_ticker_keeps_every_row(spark):
    """A third of all requests for one company, a third for tickers nobody has; nothing is lost or doubled."""
    requests = spark.range(900).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, "aa")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("none"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("b"), (F.col("id") % 7).cast("string")))
        .alias("ticker"),
        F.lit(None).cast("int").alias("start_year"),
        F.when(F.col("id") % 2 == 0, 2020).cast("int").alias("end_year"),
    )
    entries = {"0": {"ticker": "AA", "cik_str": 1}} | {
        str(i): {"ticker": f"B{i}", "cik_str": i + 2} for i in range(1, 7)
    }
    registry = spark.createDataFrame([(json.dumps(entries),)], "json string")
    big = submission([(f"h-{i}", f"{2000 + i % 30}-01-01", "10-K", "d") for i in range(600)])
    pages = landed(spark, big, big).unionAll(landed(spark, submission(K), cik="0000000003"))
    found = list_filings(Inputs(requests, registry, pages, None))
    count = {r.request_status: r["count"] for r in found.gated.groupBy("request_status").count().collect()}
    # b0 is in no registry entry; b2..b6 have no submissions
    assert sum(count.values()) == 900 and count["ticker_not_found"] == 300 + sum(i % 3 == 2 and i % 7 == 0 for i in range(900))
    per_request = found.filings.groupBy("request_id").agg(
        F.count("*").alias("n"), F.max("filing_rank").alias("last"), F.countDistinct("filing_rank").alias("ranks")
    )
    hot = [r for r in per_request.collect() if r.request_id % 3 == 0]
    assert len(hot) == 300
    assert {(r.request_id % 2, r.n, r["last"], r.ranks) for r in hot} == {(0, 840, 840, 840), (1, 1200, 1200, 1200)}


def test_registry_documents_have_an_order_a_status_and_a_last_key(spark):
    landed = spark.createDataFrame(
        [
            ("b", 200, '{"1": {"ticker": "AA", "cik_str": 1}}'),
            ("a", 200, '{"1": {"ticker": "AA", "cik_str": 8}, "1": {"ticker": "AA", "cik_str": 2}, "2": {"ticker": "XX", "cik_str": 3}}'),
        ],
        "document string, http_status int, json string",
    )
    failed = spark.createDataFrame([("c", 500, "{}"), ("d", 200, '{"1": {"ticker": "CC"')], landed.schema)
    requests = spark.createDataFrame([(1, "aa"), (2, "none")], "request_id int, ticker string")

    def looked_up(registry):
        rows = f.resolve_tickers(requests, company_source(registry)).orderBy("request_id").collect()
        return [(r.cik, r.lookup_status) for r in rows]

    for rows in (landed, landed.orderBy("document"), landed.repartition(2)):
        assert looked_up(rows) == [("0000000002", "ok"), (None, "ticker_not_found")]
    assert looked_up(landed.union(failed)) == [("0000000002", "ok"), (None, "http_error")]
    assert looked_up(failed.filter("document = 'd'")) == [(None, "registry_parse_error")] * 2


def test_one_row_per_address_and_pruned_partitions(spark, tmp_path):
    landed = spark.createDataFrame(
        [("u1", 404, None), ("u1", 200, "<p>a</p>"), ("u1", 200, "<p>b</p>"), ("u2", 500, None), ("u2", 403, None)],
        "url string, http_status int, html string",
    )
    for rows in (landed, landed.repartition(3)):
        assert {(r.url, r.http_status, r.html) for r in one_per_address(rows).collect()} == {("u1", 200, "<p>a</p>"), ("u2", 403, None)}
    filings = document_place(spark.createDataFrame([("0000000001", 2001, "u1")], "cik string, year int, url string"))
    placed = landed.withColumn("url", F.col("url")).crossJoin(filings.select("company_bucket", "filing_year"))
    placed.write.partitionBy("company_bucket", "filing_year").parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    wanted = wanted_documents(table, filings.select("cik", "year", "url").filter("year > 2000"))
    assert "dynamicpruning" in wanted._jdf.queryExecution().toString()
    assert wanted.count() == 3


def test_landed_documents_are_attached_where_they_lie(spark, tmp_path):
    """Bucketed by address within their place: attaching shuffles filings, no markup; places tell addresses apart."""
    from ledgerloom.sources import documents as d

    filings = spark.createDataFrame(
        [(f"{i % 7:010d}", 2000 + i % 3, f"u{i}") for i in range(60)] + [("0000000001", 1999, "u2"), ("0000000009", 2001, "gone")],
        "cik string, year int, url string",
    )
    rows = d.document_place(filings).filter("url <> 'gone'").selectExpr(
        "url", "200 AS http_status", "concat('<p>', url, '-', filing_year, '</p>') AS html", "company_bucket", "filing_year"
    )
    failed = rows.limit(5).selectExpr("url", "500 AS http_status", "cast(null AS string) AS html", "company_bucket", "filing_year")
    table = f"landed_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    held = {k: spark.conf.get(k, None) for k in (d.CO_PARTITION, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(held, ("false", "-1", "4")):
            spark.conf.set(key, value)
        d.land_documents(rows.unionByName(failed), table, str(tmp_path / "docs"), buckets=4)
        spark.sql(f"DROP TABLE {table}")  # external: the files stay, and another session can name them
        landed = d.landed_documents(spark, table, str(tmp_path / "docs"), "url STRING, http_status INT, html STRING", buckets=4)
        attached = d.attach_documents(filings, landed)
        plan = attached._jdf.queryExecution().executedPlan().toString()
        got = {(r.cik, r.year, r.url, r.html, r.fetch_status) for r in attached.collect()}
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    assert got == {
        (r.cik, r.year, r.url, None if r.url == "gone" else f"<p>{r.url}-{r.year}</p>", "doc_not_found" if r.url == "gone" else "ok")
        for r in filings.collect()
    }
    assert set(attached.columns) == {"url", "cik", "year", "http_status", "html", "fetch_status"}
    assert not any("html" in line for line in plan.splitlines() if "Exchange" in line)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
