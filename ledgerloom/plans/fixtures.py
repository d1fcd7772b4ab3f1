"""Run inputs built from the given tables: registry, requests, submissions and filing documents.

Everything grows with its table, and every built document is bounded: a registry part holds at most
``REGISTRY_PART`` companies and a submission page at most ``PAGE`` order keys, whatever the skew.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filing import cik_pad, document_url, filing_year
from ..operators.filings import is_annual
from ..sources.documents import COMPANY_BUCKETS
from .batch import Inputs

# Declared, so that opening a table reads no footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string",
    "pages": "page_id bigint, html string",
    "part": "p_partkey bigint, p_name string, p_size int",
}
REGISTRY_PART = 100
PAGE = 100_000
PAGES = 3  # pages that the orders of a range of PAGE keys are dealt over, at every scale
ORDERS_PER_DOCUMENT = 15
PARTS_PER_CORE = 4

TITLE = "Item 8. Financial Statements and Supplementary Data"
NEXT_ITEM = "<h3>Item 9. Changes in Accountants</h3><p>tail</p>"
# Body of a filing by doc_id % 13; {T} title, {X} escaped document text, {E} next item.
VARIANTS = [
    "<h2>{T}</h2><p>{X}</p>{E}",
    '<p><a href="#i8">{T}</a></p><h2>{T}</h2><p>{X}</p>{E}',
    '<div id="toc">junk <a href="#i8">Item 8</a> <span>{T}</span></div><p>{X}</p>{E}',
    '<nav class="toc"><span>{T}</span></nav><h2>{T}</h2><p>{X}</p>{E}',
    '<section class="stock"><h2>{T}</h2><p>{X}</p>{E}</section>',
    '<div class="stock"><h2>{T}</h2><p>{X}</p>{E}</div>',
    "<h2>{T}</h2><p>{X}</p><div>{E}</div><p>after</p>",
    "<h2>{T}</h2><p>{X}</p>",
    "<p>{X}</p>",
    "<h2>ITEM&nbsp;8.&nbsp;FINANCIAL STATEMENTS</h2>a &amp; b<!-- c --><p>{X}</p>{E}",
    "<h2>{T}</h2><p>{X}</p><p>see Exhibit 4</p><p>more</p>{E}",
    "<p><b>{T}</b></p><p>{X}</p>{E}",
    '<nav class="stock"><h2>{T}</h2><p>{X}</p>{E}</nav>',
]


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One given table, with the columns that some query uses."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def variant_markup(variant: int) -> tuple[str, str]:
    """Markup before and after the document text."""
    whole = "<html><body>" + VARIANTS[variant].replace("{T}", TITLE).replace("{E}", NEXT_ITEM) + "</body></html>"
    before, after = whole.split("{X}")
    return before, after


def filing_html(doc_id: Column, text: Column) -> Column:
    escaped = F.replace(text, F.lit("&"), F.lit("&amp;"))
    variant = doc_id % len(VARIANTS)
    html = F.when(F.lit(False), F.lit(""))
    for number in range(len(VARIANTS)):
        before, after = variant_markup(number)
        html = html.when(variant == number, F.concat(F.lit(before), escaped, F.lit(after)))
    return html


def constructed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, html``: one built filing per row of ``documents``."""
    documents = scan(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", filing_html(F.col("doc_id"), F.col("text")).alias("html"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document, http_status, json``: the companies of ``customer`` as registry documents.

    Three neighbouring customers share a ticker.  Some entries lack the company key, some hold no number.  In every
    document the last key occurs twice, first with another company; one document in 17 is cut short and one not fetched.
    """
    key = F.col("c_custkey")
    ticker = F.concat(F.when(key % 2 == 0, "T").otherwise("t"), F.expr("c_custkey div 3").cast("string")).alias("ticker")
    title = F.col("c_name").alias("title")
    entry = (
        F.when(key % 50 == 7, F.to_json(F.struct(ticker, title)))
        .when(key % 50 == 9, F.to_json(F.struct(F.lit("n/a").alias("cik_str"), ticker, title)))
        .otherwise(F.to_json(F.struct(key.alias("cik_str"), ticker, title)))
    )
    return (
        scan(spark, sf_dir, "customer")
        .groupBy(F.expr(f"c_custkey div {REGISTRY_PART}").alias("part"))
        .agg(
            F.max(key).alias("last"),
            F.array_join(F.collect_list(F.concat(F.lit('"'), key.cast("string"), F.lit('":'), entry)), ",").alias("entries"),
        )
        .select(
            F.format_string("part-%08d", "part").alias("document"),
            F.when(F.col("part") % 17 == 16, 503).otherwise(200).alias("http_status"),
            F.concat(
                F.lit('{"'), F.col("last").cast("string"), F.lit('":{"cik_str":1,"ticker":"TWICE","title":"first"},'), "entries",
                F.when(F.col("part") % 17 == 15, "").otherwise("}"),
            ).alias("json"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per ticker, with and without year bounds, plus some for tickers nobody has."""
    customer = scan(spark, sf_dir, "customer").select("c_custkey")
    known = customer.select(F.expr("c_custkey div 3").alias("request_id")).distinct().select(
        "request_id",
        F.concat(F.when(F.col("request_id") % 2 == 0, "T").otherwise("t"), F.col("request_id").cast("string")).alias(
            "ticker"
        ),
        F.when(F.col("request_id") % 2 == 1, 1997).cast("int").alias("start_year"),
        F.when(F.col("request_id") % 3 != 0, 2000).cast("int").alias("end_year"),
    )
    unknown = customer.filter(F.col("c_custkey") % 500 == 3).select(
        (F.col("c_custkey") + 10_000_000_000).alias("request_id"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.lit(None).cast("int").alias("start_year"),
        F.lit(None).cast("int").alias("end_year"),
    )
    return known.unionAll(unknown)


def spread(frame: DataFrame) -> DataFrame:
    """Small rows that much is made of, dealt over all cores: a table of few bytes is scanned by few tasks.  Adaptive
    execution does not join a stated number of parts again."""
    return frame.repartition(PARTS_PER_CORE * frame.sparkSession.sparkContext.defaultParallelism)


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a filing: ``custkey, orderkey, page, cik, accession, filing_date, form, primary_doc``."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    cik = cik_pad(customer)
    form = F.element_at(
        F.array(*[F.lit(x) for x in ("10-K", "10-Q", "8-K", "10-K/A", "4")]),
        F.substring("o_orderpriority", 1, 1).cast("int"),
    )
    return scan(spark, sf_dir, "orders").select(
        customer.alias("custkey"),
        key.alias("orderkey"),
        F.expr(f"o_orderkey div {PAGE} * {PAGES} + o_orderkey % {PAGES}").cast("int").alias("page"),
        cik.alias("cik"),
        F.concat_ws("-", cik, F.date_format(day, "yy"), F.format_string("%06d", key)).alias("accession"),
        F.unix_date(day).alias("day"),
        F.when((customer % 83 == 4) & (key % 5 == 0), "n/a")
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("filing_date"),
        form.alias("form"),
        F.concat(F.lit("d"), key.cast("string"), F.lit(".htm")).alias("primary_doc"),
    )


def submission_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``custkey, page, rows, cik, http_status``: the filings of each page of a customer, newest first; a fetch may fail."""
    custkey = F.col("custkey")
    return (
        order_filings(spark, sf_dir)
        .groupBy("custkey", "page")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("day")).alias("age"), "orderkey", "accession", "filing_date", "form", "primary_doc",
                        (F.col("orderkey") % 2).cast("int").alias("xbrl"),
                    )
                )
            ).alias("rows")
        )
        .withColumns({"cik": cik_pad(custkey), "http_status": F.when(custkey % 79 == 2, 500).otherwise(200)})
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cik, page, http_status, json``: the filings of each customer as submission documents, newest first.

    Faults by customer: short ``primaryDocument`` or ``form`` arrays, a missing mandatory field at the top
    or in an address, a number or list where a text belongs (at the top, in a list, an address, a former name, a file entry),
    a text cut short, a failed fetch.
    """
    custkey = F.col("custkey")

    # fields of all rows at once, without a lambda a row
    def column(name: str) -> Column:
        return F.col(f"rows.{name}")

    def repeated(value) -> Column:
        return F.array_repeat(F.lit(value), F.size("rows"))

    def shortened(values: Column, fault: Column) -> Column:
        return F.when(fault, F.slice(values, F.lit(1), F.size(values) - 1)).otherwise(values)

    empty = repeated("")
    recent = F.struct(
        column("accession").alias("accessionNumber"),
        column("filing_date").alias("filingDate"),
        column("filing_date").alias("reportDate"),
        F.transform(column("filing_date"), lambda date: F.concat(date, F.lit("T00:00:00.000Z"))).alias("acceptanceDateTime"),
        empty.alias("act"),
        shortened(column("form"), custkey % 97 == 7).alias("form"),
        empty.alias("fileNumber"),
        empty.alias("filmNumber"),
        empty.alias("items"),
        column("orderkey").alias("size"),
        column("xbrl").alias("isXBRL"),
        repeated(0).alias("isInlineXBRL"),
        shortened(column("primary_doc"), custkey % 97 == 3).alias("primaryDocument"),
        empty.alias("primaryDocDescription"),
    )
    address = F.struct(
        F.lit("1 Main St").alias("street1"),
        F.when(custkey % 89 != 7, "Town").alias("city"),
        F.lit("NY").alias("stateOrCountry"),
        F.lit("10001").alias("zipCode"),
        F.lit("NY").alias("stateOrCountryDescription"),
    )
    json = F.to_json(
        F.struct(
            "cik",
            F.lit("operating").alias("entityType"),
            F.lit("7372").alias("sic"),
            F.lit("Services").alias("sicDescription"),
            F.lit(0).alias("insiderTransactionForOwnerExists"),
            F.lit(1).alias("insiderTransactionForIssuerExists"),
            F.concat(F.lit("Company "), custkey.cast("string")).alias("name"),
            F.array(F.concat(F.lit("T"), F.expr("custkey div 3").cast("string"))).alias("tickers"),
            F.array(F.lit("NYSE")).alias("exchanges"),
            F.when(custkey % 89 != 5, "Large").alias("category"),
            F.lit("1231").alias("fiscalYearEnd"),
            F.lit("DE").alias("stateOfIncorporation"),
            F.lit("DE").alias("stateOfIncorporationDescription"),
            F.create_map(F.lit("mailing"), address).alias("addresses"),
            F.lit("555-0100").alias("phone"),
            F.lit("").alias("flags"),
            F.array(
                F.struct(F.lit("Old").alias("name"), F.lit("1990").alias("from"), F.lit("1991").alias("to"))
            ).alias("formerNames"),
            F.struct(
                recent.alias("recent"),
                F.array(
                    F.struct(
                        F.lit("older.json").alias("name"),
                        F.lit(1).alias("filingCount"),
                        F.lit("1990").alias("filingFrom"),
                        F.lit("1991").alias("filingTo"),
                    )
                ).alias("files"),
            ).alias("filings"),
        )
    )
    # numbers where texts belong, in a field and in a list
    json = (
        F.when(custkey % 89 == 9, F.replace(json, F.lit('"sic":"7372"'), F.lit('"sic":7372')))
        .when(custkey % 89 == 10, F.replace(json, F.lit('"exchanges":["NYSE"]'), F.lit('"exchanges":["NYSE",5]')))
        .when(custkey % 89 == 11, F.replace(json, F.lit('"zipCode":"10001"'), F.lit('"zipCode":10001')))
        .when(custkey % 89 == 12, F.replace(json, F.lit('"from":"1990"'), F.lit('"from":1990')))
        .when(custkey % 89 == 13, F.replace(json, F.lit('"name":"older.json"'), F.lit('"name":["older.json"]')))
        .when(custkey % 89 == 14, F.replace(json, F.lit('"street1":"1 Main St"'), F.lit('"street1":1')))
        .otherwise(json)
    )
    whole = F.when(custkey % 89 == 8, F.substring(json, F.lit(1), F.length(json) - 1)).otherwise(json)
    # made in a generator: a later semi-join on the company is moved below it, so only wanted documents are written
    return submission_pages(spark, sf_dir).select("cik", "page", "http_status", F.explode(F.array(whole)).alias("json"))


def document_status(doc_id: Column) -> Column:
    return F.when(doc_id % 101 == 1, 403).when(doc_id % 103 == 1, 404).when(doc_id % 107 == 1, 500).otherwise(200)


def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, http_status, html, company_bucket, filing_year``: annual filings with the built markup of ``documents``.

    Each document stands for the annual orders among ``ORDERS_PER_DOCUMENT`` neighbouring ones; an order in seven has
    no landed document, and one in eleven landed a second time, not fetched.
    """
    key = F.col("orderkey")
    filings = order_filings(spark, sf_dir).filter(is_annual(F.col("form")) & (key % 7 != 3)).select(
        "orderkey",
        F.expr(f"orderkey div {ORDERS_PER_DOCUMENT}").alias("doc_id"),
        document_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url"),
        F.pmod(F.xxhash64("cik"), F.lit(COMPANY_BUCKETS)).cast("int").alias("company_bucket"),
        filing_year(F.col("filing_date")).cast("int").alias("filing_year"),
    )
    status = document_status(F.col("doc_id"))
    first = F.struct(status.alias("http_status"), F.col("html"))
    again = F.struct(F.lit(503).alias("http_status"), F.lit(None).cast("string").alias("html"))
    # made in a generator: a later semi-join on the address is moved below it and below the join, so only wanted
    # filings meet their text
    landings = F.when(key % 11 == 5, F.array(first, again)).otherwise(F.array(first))
    landed = constructed_documents(spark, sf_dir).join(filings, "doc_id")
    return landed.select("url", F.inline(landings), "company_bucket", "filing_year")


def listing_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """What the filing list needs; no documents."""
    return Inputs(requests(spark, sf_dir), registry(spark, sf_dir), submissions(spark, sf_dir), None)


def all_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return replace(listing_inputs(spark, sf_dir), documents=landed_documents(spark, sf_dir))
