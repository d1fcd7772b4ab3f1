"""The same results as ANSI SQL over the given tables, one text per query."""

from __future__ import annotations

from .catalog import SPAN_PATTERNS, TEXT_PATTERNS
from .fixtures import NEXT_ITEM, ORDERS_PER_DOCUMENT, PAGE, PAGES, REGISTRY_PART, TITLE, VARIANTS, variant_markup

ROOT = "https://www.sec.gov/Archives/edgar/data"
NEXT_TEXT = "Item 9. Changes in Accountantstail"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- filing list -------------------------------------------------------------------------------------
REG = f"""part AS (
  SELECT *, c_custkey // {REGISTRY_PART} AS part, printf('part-%08d', c_custkey // {REGISTRY_PART}) AS document,
    CASE (c_custkey // {REGISTRY_PART}) % 17 WHEN 16 THEN 'http_error' WHEN 15 THEN 'registry_parse_error' ELSE 'ok' END AS doc_status
  FROM customer),
reg AS (
  SELECT document, CAST(c_custkey AS VARCHAR) AS idx, c_custkey AS k, c_name, 'T' || CAST(c_custkey // 3 AS VARCHAR) AS tkey,
    CASE WHEN c_custkey % 50 = 7 THEN 'missing' WHEN c_custkey % 50 = 9 THEN 'invalid' ELSE 'ok' END AS state
  FROM part WHERE doc_status = 'ok')"""
REQ = """req AS (
  SELECT DISTINCT c_custkey // 3 AS request_id, 'T' || CAST(c_custkey // 3 AS VARCHAR) AS tkey,
    CASE WHEN (c_custkey // 3) % 2 = 1 THEN 1997 END AS start_year,
    CASE WHEN (c_custkey // 3) % 3 <> 0 THEN 2000 END AS end_year
  FROM customer
  UNION ALL
  SELECT c_custkey + 10000000000, 'U' || CAST(c_custkey AS VARCHAR), NULL, NULL FROM customer WHERE c_custkey % 500 = 3)"""
RES = """hit AS (
  SELECT tkey, arg_min(k, (document, idx)) AS k, arg_min(state, (document, idx)) AS state FROM reg WHERE state <> 'missing' GROUP BY tkey),
res AS (
  SELECT r.*, CASE WHEN h.tkey IS NULL THEN coalesce((SELECT min(doc_status) FROM part WHERE doc_status <> 'ok'), 'ticker_not_found') WHEN h.state = 'invalid' THEN 'invalid_cik'
      ELSE 'ok' END AS lookup_status,
    CASE WHEN h.state = 'ok' THEN h.k END AS k
  FROM req r LEFT JOIN hit h ON h.tkey = r.tkey)"""
FIL = f"""fil0 AS (
  SELECT o_custkey AS k, o_orderkey AS orderkey, o_orderkey // {PAGE} * {PAGES} + o_orderkey % {PAGES} AS page, printf('%010d', o_custkey) AS cik,
    printf('%010d', o_custkey) || '-' || strftime(o_orderdate, '%y') || '-' || printf('%06d', o_orderkey) AS accession,
    CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_custkey % 83 = 4 AND o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fdate,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-Q' WHEN '3' THEN '8-K'
      WHEN '4' THEN '10-K/A' ELSE '4' END AS form0,
    'd' || CAST(o_orderkey AS VARCHAR) || '.htm' AS doc0
  FROM orders),
fil AS (
  SELECT *, '{ROOT}/' || cik || '/' || replace(accession, '-', '') || '/' || doc0 AS url,
    CASE WHEN regexp_matches(fdate, '^[+0-9][0-9]{{3}}') THEN CAST(substr(fdate, 1, 4) AS BIGINT) END AS year,
    row_number() OVER (PARTITION BY k, page ORDER BY day DESC, orderkey) - 1 AS pos,
    count(*) OVER (PARTITION BY k, page) AS n
  FROM fil0)"""
IDX = """idx AS (
  SELECT *, CASE WHEN k % 97 = 7 AND pos = n - 1 THEN NULL ELSE form0 END AS form,
    CASE WHEN k % 97 = 3 AND pos = n - 1 THEN NULL ELSE doc0 END AS prim,
    CASE WHEN k % 79 = 2 THEN 'http_error' WHEN k % 89 IN (5, 7, 8, 9, 10, 11, 12, 13, 14) THEN 'submissions_parse_error' ELSE 'ok'
      END AS doc_status
  FROM fil)"""
GATE = """comp AS (
  SELECT k, bool_or(doc_status = 'http_error') AS unreachable,
    bool_or(doc_status = 'submissions_parse_error' OR form IS NULL OR (form = '10-K' AND year IS NULL)) AS broken
  FROM idx GROUP BY k),
rng AS (
  SELECT r.request_id, bool_or(f.prim IS NULL) AS incomplete
  FROM res r JOIN idx f ON f.k = r.k
  WHERE f.form = '10-K' AND (r.start_year IS NULL OR f.year >= r.start_year)
    AND (r.end_year IS NULL OR f.year <= r.end_year)
  GROUP BY r.request_id),
gate AS (
  SELECT r.*, CASE WHEN r.lookup_status <> 'ok' THEN r.lookup_status
      WHEN c.k IS NULL OR c.unreachable THEN 'http_error'
      WHEN c.broken OR g.incomplete THEN 'submissions_parse_error'
      WHEN g.request_id IS NULL THEN 'no_filings' ELSE 'ok' END AS request_status
  FROM res r LEFT JOIN comp c ON c.k = r.k LEFT JOIN rng g ON g.request_id = r.request_id)"""
LST = """lst AS (
  SELECT g.request_id, g.tkey AS ticker, f.k, f.cik, f.accession, f.fdate, f.form, f.prim, f.year, f.url, f.orderkey,
    'Company ' || CAST(f.k AS VARCHAR) AS company_name,
    row_number() OVER (PARTITION BY g.request_id ORDER BY f.year DESC, f.page, f.pos) AS filing_rank
  FROM gate g JOIN idx f ON f.k = g.k
  WHERE g.request_status = 'ok' AND f.form = '10-K' AND (g.start_year IS NULL OR f.year >= g.start_year)
    AND (g.end_year IS NULL OR f.year <= g.end_year))"""
LISTING = [REG, REQ, RES, FIL, IDX, GATE, LST]

# --- built filings -----------------------------------------------------------------------------------
HTTP = """CASE WHEN doc_id % 101 = 1 THEN 403 WHEN doc_id % 103 = 1 THEN 404 WHEN doc_id % 107 = 1 THEN 500 ELSE 200 END"""
DOC = f"""doc AS (
  SELECT doc_id, doc_id % {len(VARIANTS)} AS v, text, replace(text, '&', '&amp;') AS x, {HTTP} AS http_status
  FROM documents)"""
MARKUP = (
    "CASE v "
    + " ".join(
        "WHEN {} THEN {} || x || {}".format(v, *map(_quote, variant_markup(v))) for v in range(len(VARIANTS))
    )
    + " END"
)
CUT = f"""cut AS (
  SELECT *, CASE WHEN v IN (0, 1, 2, 3, 4, 10) THEN '<p>' || x || '</p>'
      WHEN v = 6 THEN '<p>' || x || '</p><div>{NEXT_ITEM}</div><p>after</p>'
      WHEN v = 9 THEN 'a & b<p>' || x || '</p>' END AS content
  FROM doc)"""
EXT = """ext AS (
  SELECT *, CASE WHEN v IN (8, 12) THEN 'no_start' WHEN v IN (5, 7, 11) THEN 'no_end'
      WHEN strlen(content) < 1000 THEN 'below_min' END AS reason
  FROM cut)"""
BUILT = [DOC, CUT, EXT]
LINK = f"{{order}}.orderkey // {ORDERS_PER_DOCUMENT} = {{doc}}.doc_id AND {{order}}.orderkey % 7 <> 3"
OUT = f"""outc AS (
  SELECT l.*, e.reason AS reason0, e.content,
    CASE WHEN e.doc_id IS NULL OR e.http_status = 404 THEN 'doc_not_found' WHEN e.http_status = 403 THEN 'rate_limited'
      WHEN e.http_status <> 200 THEN 'http_error' WHEN e.reason IS NULL THEN 'ok' ELSE 'section_not_found' END AS status
  FROM lst l LEFT JOIN ext e ON {LINK.format(order="l", doc="e")})"""
OUTCOME = [*LISTING, *BUILT, OUT]
LAST = """last AS (
  SELECT ticker, year, arg_max(accession, (request_id, filing_rank)) AS accession,
    arg_max(company_name, (request_id, filing_rank)) AS company_name,
    arg_max(content, (request_id, filing_rank)) AS content
  FROM outc WHERE status = 'ok' GROUP BY ticker, year)"""
SUM = """tot AS (
  SELECT g.request_id, g.request_status, count(*) FILTER (WHERE o.status = 'ok') AS success_count,
    count(*) FILTER (WHERE o.status <> 'ok') AS failure_count
  FROM gate g LEFT JOIN outc o ON o.request_id = g.request_id GROUP BY g.request_id, g.request_status)"""

# Node numbers by variant, read off the built markup (html 0, head 1, body 2, then in document order).
HEADERS = (
    "0 h2 3, 0 h3 7, 1 a 4, 1 h2 6, 1 h3 10, 2 div 3, 2 a 5, 2 span 8, 2 h3 12, 3 span 4, 3 h2 6, 3 h3 10, 4 h2 4, "
    "4 h3 8, 5 div 3, 5 h2 4, 5 h3 8, 6 h2 3, 6 div 7, 6 h3 8, 7 h2 3, 9 h2 3, 9 h3 9, 10 h2 3, 10 h3 11, 11 b 4, "
    "11 h3 8, 12 h2 4, 12 h3 8"
)
STARTS = (
    "0 h2 3, 1 a 4, 1 h2 6, 2 div 3, 2 span 8, 3 span 4, 3 h2 6, 4 h2 4, 5 div 3, 5 h2 4, 6 h2 3, 7 h2 3, 9 h2 3, "
    "10 h2 3, 11 b 4, 12 h2 4"
)
INSIDE = "2 a 5, 2 span 8, 3 span 4, 5 h2 4, 5 h3 8, 12 h2 4, 12 h3 8"
OUTSIDE = (
    "0 h2 3, 1 h2 6, 2 div 3, 3 h2 6, 4 h2 4, 5 div 3, 6 h2 3, 7 h2 3, 9 h2 3, 10 h2 3, 11 b 4"
)
SIBLINGS = (
    "0 p 5, 0 h3 7, 0 p 9, 1 p 8, 1 h3 10, 1 p 12, 2 p 10, 2 h3 12, 2 p 14, 3 p 8, 3 h3 10, 3 p 12, 4 p 6, 4 h3 8, "
    "4 p 10, 6 p 5, 6 div 7, 6 p 12, 7 p 5, 9 p 7, 9 h3 9, 9 p 11, 10 p 5, 10 p 7, 10 p 9, 10 h3 11, 10 p 13"
)
NESTED = "6 h3 8"
TOP = "0 h3 7, 1 h3 10, 2 h3 12, 3 h3 10, 4 h3 8, 6 div 7, 9 h3 9, 10 p 7, 10 h3 11"
# Strict mode: innermost starts outside contents blocks, up to the block that holds nothing else; ends likewise.
STRICT_STARTS = "0 h2 3, 1 h2 6, 3 h2 6, 4 h2 4, 5 h2 4, 6 h2 3, 7 h2 3, 9 h2 3, 10 h2 3, 11 p 3, 12 h2 4"
STRICT_ENDS = "0 h3 7, 1 h3 10, 3 h3 10, 4 h3 8, 5 h3 8, 6 div 7, 9 h3 9, 10 p 7, 11 h3 8, 12 h3 8"
STRICT_CUT = """cut AS (
  SELECT *, CASE WHEN v IN (0, 1, 3, 4, 5, 6, 10, 11, 12) THEN '<p>' || x || '</p>'
      WHEN v = 9 THEN 'a & b<p>' || x || '</p>' END AS content
  FROM doc)"""
STRICT_EXT = """ext AS (
  SELECT *, CASE WHEN v IN (2, 8) THEN 'no_start' WHEN v = 7 THEN 'no_end' WHEN strlen(content) < 1000 THEN 'below_min' END AS reason
  FROM cut)"""
ENDS = "0 h3 7, 1 h3 10, 2 h3 12, 3 h3 10, 4 h3 8, 6 h3 8, 9 h3 9, 10 p 7"
# variant, nodes, elements, comments, depth
SHAPES = (
    "(0, 11, 7, 0, 3), (1, 14, 9, 0, 4), (2, 16, 9, 0, 4), (3, 14, 9, 0, 4), (4, 12, 8, 0, 4), (5, 12, 8, 0, 4), "
    "(6, 14, 9, 0, 4), (7, 7, 5, 0, 3), (8, 5, 4, 0, 3), (9, 13, 7, 1, 3), (10, 15, 9, 0, 3), (11, 12, 8, 0, 4), "
    "(12, 12, 8, 0, 4)"
)
FIXED_TEXTS = [
    TITLE + NEXT_TEXT,
    TITLE * 2 + NEXT_TEXT,
    "junk Item 8 " + TITLE + NEXT_TEXT,
    TITLE * 2 + NEXT_TEXT,
    TITLE + NEXT_TEXT,
    TITLE + NEXT_TEXT,
    TITLE + NEXT_TEXT + "after",
    TITLE,
    "",
    "ITEM\u00a08.\u00a0FINANCIAL STATEMENTSa & b" + NEXT_TEXT,
    TITLE + "see Exhibit 4more" + NEXT_TEXT,
    TITLE + NEXT_TEXT,
    TITLE + NEXT_TEXT,
]


def _values(spec: str) -> str:
    rows = (entry.split() for entry in spec.split(", "))
    return ", ".join(f"({v}, '{tag}', {node})" for v, tag, node in rows)


def _nodes(spec: str, every_document: bool = False) -> str:
    join = "LEFT JOIN" if every_document else "JOIN"
    return _with(
        [DOC],
        f"""SELECT d.doc_id, CAST(e.node_id AS BIGINT) AS node_id, e.tag
FROM doc d {join} (VALUES {_values(spec)}) e(v, tag, node_id) ON e.v = d.v""",
    )


PAGE_TAGS = r"""src AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'),
    '(<script[^>]*>).*?(</script>|$)', '\1', 'gs') AS html FROM pages),
tags AS (
  SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1))) AS tag FROM src)"""
# A b that is never closed is opened again in every later paragraph and in the footer, three times at most.
PAGE_BOLD = """para AS (
  SELECT page_id, i, regexp_replace(split_part(split_part(s, '</p>', 1), '</article>', 1), '<[^>]*$', '') AS inside, (strlen(s) - strlen(replace(s, '<b>', ''))) // 3 AS own
  FROM (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT page_id, string_split(html, '<p>') AS l FROM src))),
bold AS (
  SELECT *, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM para),
foot AS (
  SELECT page_id, regexp_replace(regexp_extract(html, '<footer>(.*)$', 1, 's'), '<[^>]*$', '') <> '' AS has FROM src),
reopened AS (
  SELECT page_id, coalesce(sum(least(before, 3)) FILTER (WHERE i > 1 AND inside <> ''), 0)
    + CASE WHEN any_value(has) THEN least(sum(own), 3) ELSE 0 END AS n
  FROM bold JOIN foot USING (page_id) GROUP BY page_id)"""
PAGE_TEXTS = r"""cand AS (
  SELECT page_id, 'h1' AS tag, unnest(regexp_extract_all(html, '<h1>(.*?)(?:</h1>|$)', 1, 's')) AS raw FROM src
  UNION ALL SELECT page_id, 'div', unnest(regexp_extract_all(html, '<div class="ad">(.*?)(?:</div>|$)', 1, 's')) FROM src
  UNION ALL SELECT page_id, 'a', unnest(regexp_extract_all(html, '<a href="[^"]*">(.*?)(?:</a>|$)', 1, 's')) FROM src
  UNION ALL SELECT page_id, 'b', CASE WHEN before > 0 THEN inside ELSE regexp_replace(inside, '^.*?<b>', '', 's') END
    FROM bold WHERE i > 1 AND inside <> '' AND before + own > 0)"""


#: Tags out; a reference cut off before its semicolon still counts.
TEXT_OF = r"regexp_replace(regexp_replace(regexp_replace(raw, '<[^>]*$', ''), '<[^>]*>', '', 'g'), '&(copy|middot|lt|gt|quot|amp)$', '&\1;')"


def _decoded(column: str) -> str:
    pairs = [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]
    for entity, char in pairs:
        column = f"replace({column}, '{entity}', '{char}')"
    return column


WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || " + " || ".join(
    f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WRAPPED = "chr(160) || ' ' || chr(10) || ' ' || chr(8195) || text || chr(10) || 'a&nbsp;b&#160;c' || chr(160) || ' ' || chr(12288) || chr(9) || chr(10)"

SPANS = (
    "hits AS (\n  "
    + "\n  UNION ALL ".join(
        f"SELECT doc_id, text, {at} AS pattern_no, {_quote(kind)} AS kind, string_split_regex(text, {_quote(pattern)}) AS gaps, "
        f"regexp_extract_all(text, {_quote(pattern)}) AS hits FROM documents"
        for at, (pattern, kind) in enumerate(SPAN_PATTERNS)
    )
    + """),
flat AS (
  SELECT doc_id, text, pattern_no, kind, unnest(range(len(hits))) AS i, unnest(hits) AS hit,
    unnest(gaps[1:len(hits)]) AS gap
  FROM hits),
span AS (
  SELECT doc_id, text, pattern_no, kind, hit,
    CAST(sum(strlen(gap) + strlen(hit)) OVER w AS BIGINT) AS span_end, strlen(hit) AS n_bytes,
    CAST(sum(length(gap) + length(hit)) OVER w AS BIGINT) AS char_end, length(hit) AS n_chars
  FROM flat WINDOW w AS (PARTITION BY doc_id, pattern_no ORDER BY i))"""
)
SHELL = """'<!DOCTYPE html>
<html>
<head>
<style>
.highlight-start { background-color: #FFFF00; }
.highlight-end { background-color: #FFA500; }
.highlight-item8 { background-color: #90EE90; }
.highlight-item9 { background-color: #ADD8E6; }
.highlight-custom { background-color: #FFC0CB; }
</style>
</head>
<body>
'"""

ORACLES: dict[str, str] = {
    "S1_company_source": _with(
        [REG],
        """SELECT idx, CASE WHEN k % 2 = 0 THEN tkey ELSE lower(tkey) END AS ticker,
  CASE WHEN state = 'ok' THEN k END AS cik, state AS cik_state, c_name AS title, document, 'ok' AS doc_status FROM reg
UNION ALL SELECT DISTINCT NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, document, doc_status FROM part WHERE doc_status <> 'ok'""",
    ),
    "S2_submissions_source": _with(
        [FIL, IDX],
        """SELECT cik, page, k % 89 = 8 AS corrupt,
  CASE WHEN k % 89 <> 8 THEN 'Company ' || CAST(k AS VARCHAR) END AS name,
  CASE WHEN k % 89 NOT IN (5, 8) THEN 'Large' END AS category,
  CASE WHEN k % 89 NOT IN (7, 8) THEN 'Town' END AS city,
  CASE WHEN k % 89 <> 8 THEN count(*) END AS n_filings,
  CASE WHEN k % 89 <> 8 THEN count(prim) END AS n_documents,
  CASE WHEN k % 89 <> 8 THEN max(accession) FILTER (WHERE pos = 0) END AS first_accession,
  CASE WHEN k % 89 <> 8 THEN CAST(sum(orderkey % 2) AS BIGINT) END AS n_xbrl
FROM idx GROUP BY k, cik, page""",
    ),
    "S3_required_fields": _with([FIL, IDX], "SELECT DISTINCT cik, page, doc_status FROM idx"),
    "S4_document_attach": _with(
        [FIL, DOC],
        f"""SELECT f.accession, f.url,
  CASE WHEN d.doc_id IS NULL OR d.http_status = 404 THEN 'doc_not_found' WHEN d.http_status = 403 THEN 'rate_limited'
    WHEN d.http_status = 200 THEN 'ok' ELSE 'http_error' END AS fetch_status,
  strlen({MARKUP}) AS html_bytes
FROM fil f LEFT JOIN doc d ON {LINK.format(order='f', doc='d')} WHERE f.form0 = '10-K'""",
    ),
    "S5_fetch_status": _with(
        [DOC],
        """SELECT doc_id,
  CASE WHEN doc_id % 109 = 1 OR http_status = 404 THEN 'doc_not_found' WHEN http_status = 403 THEN 'rate_limited'
    WHEN http_status = 200 THEN 'ok' ELSE 'http_error' END AS fetch_status,
  CASE WHEN http_status = 200 THEN 'ok' ELSE 'http_error' END AS listing_status FROM doc""",
    ),
    "P1_zip_filings": _with(
        [FIL, IDX],
        """SELECT cik, page, pos, accession AS accession_number, form AS form_type, fdate AS filing_date,
  prim AS primary_doc FROM idx WHERE doc_status = 'ok'""",
    ),
    "P2_short_array_check": _with(
        [REG, REQ, RES, FIL, IDX, GATE],
        "SELECT request_id, request_status = 'submissions_parse_error' AS parse_error FROM gate",
    ),
    "P3_form_filter": _with(
        [FIL, IDX],
        "SELECT accession AS accession_number, form AS form_type FROM idx WHERE doc_status = 'ok' AND form = '10-K'",
    ),
    "P4_filing_year": _with([FIL], "SELECT accession, fdate AS filing_date, year FROM fil"),
    "P5_year_range": _with(
        [REG, REQ, RES, FIL, IDX],
        """SELECT r.request_id, f.accession AS accession_number
FROM res r JOIN idx f ON f.k = r.k WHERE f.doc_status = 'ok' AND f.form = '10-K'
  AND (r.start_year IS NULL OR f.year >= r.start_year) AND (r.end_year IS NULL OR f.year <= r.end_year)""",
    ),
    "P6_filing_record": _with(
        LISTING,
        """SELECT request_id, accession AS accession_number, fdate AS filing_date, form AS form_type, ticker,
  company_name, cik, prim AS primary_doc, year FROM lst""",
    ),
    "P7_cik_pad": "SELECT c_custkey, printf('%010d', c_custkey) AS cik, printf('%010d', c_custkey + 12345678901) AS long_cik FROM customer",
    "P8_doc_url": _with([FIL], "SELECT orderkey, url FROM fil"),
    "P9_clean_text": _with(
        [f"w AS (SELECT doc_id, trim({WRAPPED}, {WHITE}) AS t FROM documents)"],
        """SELECT doc_id, replace(replace(replace(t, chr(10), ' '), '&nbsp;', ' '), '&#160;', ' ') AS start_text,
  replace(replace(t, chr(10), ' '), '&nbsp;', ' ') AS end_text,
  replace(replace(t, '&nbsp;', ' '), '&#160;', ' ') AS toc_text FROM w""",
    ),
    "P10_match_any": "SELECT doc_id, "
    + " OR ".join(f"regexp_matches(text, {_quote(p)})" for p in TEXT_PATTERNS)
    + " AS matched FROM documents",
    "P10_match_any_headings": """WITH h AS (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Item ' ELSE 'ITEM ' END || CAST(p_size AS VARCHAR) ||
    CASE WHEN p_partkey % 3 = 0 THEN '. Financial Statements ' ELSE '. Changes ' END || p_name AS t FROM part)
SELECT p_partkey, regexp_matches(t, '(?i)^item 8\\. financial statements') AS starts,
  regexp_matches(t, '(?i)^item (9|10)\\. ') OR regexp_matches(t, '(?i)\\b(signatures|exhibits?|part\\s+iii)\\b') AS ends
FROM h""".replace("\\\\", "\\"),
    "P11_byte_length": "SELECT doc_id, strlen(text) AS n_bytes FROM documents",
    "P12_min_size": _with(
        BUILT,
        "SELECT doc_id, strlen(content) AS content_length, coalesce(reason = 'below_min', false) AS below_min FROM ext",
    ),
    "P13_section_record": _with(
        BUILT,
        """SELECT 'Item 8' AS section_name, 'Financial Statements and Supplementary Data' AS section_title,
  content AS content_html, 1995 + doc_id % 7 AS filing_year, 'Company ' || CAST(doc_id AS VARCHAR) AS company_name,
  'D' || CAST(doc_id AS VARCHAR) AS ticker FROM ext WHERE reason IS NULL""",
    ),
    "P14_metadata_record": _with(
        BUILT,
        """SELECT 'D' || CAST(doc_id AS VARCHAR) AS ticker, 'Company ' || CAST(doc_id AS VARCHAR) AS company_name,
  1995 + doc_id % 7 AS filing_year, 'Item 8' AS section_name,
  'Financial Statements and Supplementary Data' AS section_title, strlen(content) AS content_length
FROM ext WHERE reason IS NULL""",
    ),
    "H1_html_nodes": _with(
        [PAGE_TAGS, PAGE_BOLD],
        """SELECT page_id, tag, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT page_id, tag, count(*) AS n FROM tags GROUP BY page_id, tag UNION ALL SELECT page_id, 'b', n FROM reopened WHERE n > 0)
GROUP BY page_id, tag""",
    ),
    "H1_html_nodes_filings": _with(
        [DOC],
        f"""SELECT d.doc_id, CAST(s.n_nodes AS BIGINT) AS n_nodes, CAST(s.n_elements AS BIGINT) AS n_elements,
  CAST(s.n_comments AS BIGINT) AS n_comments, CAST(s.max_depth AS BIGINT) AS max_depth,
  strlen(d.text) + CASE d.v {" ".join(f"WHEN {v} THEN {len(t.encode())}" for v, t in enumerate(FIXED_TEXTS))} END AS text_bytes
FROM doc d JOIN (VALUES {SHAPES}) s(v, n_nodes, n_elements, n_comments, max_depth) ON s.v = d.v""",
    ),
    "H2_header_candidates": _with(
        [PAGE_TAGS, PAGE_BOLD],
        """SELECT page_id, tag, count(*) AS n FROM tags
WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'font', 'div', 'span', 'a') GROUP BY page_id, tag
UNION ALL SELECT page_id, 'b', count(*) FROM bold WHERE i > 1 AND inside <> '' AND before + own > 0 GROUP BY page_id""",
    ),
    "H2_header_candidates_filings": _nodes(HEADERS),
    "H3_element_text": _with(
        [PAGE_TAGS, PAGE_BOLD, PAGE_TEXTS],
        f"""SELECT page_id, tag, {_decoded(TEXT_OF)} AS text FROM cand""",
    ),
    "H3_element_text_filings": _with(
        [DOC],
        f"""SELECT d.doc_id, CAST(e.node_id AS BIGINT) AS node_id, e.tag,
  CASE WHEN e.v = 2 AND e.tag = 'a' THEN 'Item 8' WHEN e.v = 2 AND e.tag = 'div' THEN 'junk Item 8 {TITLE}'
    WHEN e.v = 5 AND e.tag = 'div' THEN '{TITLE}' || d.text || '{NEXT_TEXT}' WHEN e.v = 6 AND e.tag = 'div' THEN '{NEXT_TEXT}'
    WHEN e.v = 9 AND e.tag = 'h2' THEN 'ITEM' || chr(160) || '8.' || chr(160) || 'FINANCIAL STATEMENTS'
    WHEN e.tag = 'h3' THEN 'Item 9. Changes in Accountants' ELSE '{TITLE}' END AS text
FROM doc d JOIN (VALUES {_values(HEADERS)}) e(v, tag, node_id) ON e.v = d.v""",
    ),
    "B1_start_match": _nodes(STARTS),
    "B2_toc_self_link": "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS BIGINT) AS n FROM pages",
    "B3_toc_ancestor": _nodes(INSIDE),
    "B4_toc_table_item": """SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AS toc_item FROM part""",
    "B5_toc_exclude": _nodes(OUTSIDE),
    "B6_first_start": _nodes(OUTSIDE, every_document=True),
    "B7_following_siblings": _nodes(SIBLINGS),
    "B8_end_in_descendants": _nodes(NESTED),
    "B9_end_sibling_self": _nodes(TOP),
    "B10_first_end": _nodes(ENDS, every_document=True),
    "B11_slice": _with([DOC, CUT], "SELECT doc_id, content AS content_html FROM cut"),
    "B12_extract_section": _with(
        BUILT,
        """SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'section_not_found' END AS status, reason,
  CASE WHEN reason IS NULL THEN content END AS content_html, strlen(content) AS content_length FROM ext""",
    ),
    "B6_first_start_strict": _nodes(STRICT_STARTS, every_document=True),
    "B10_first_end_strict": _nodes(STRICT_ENDS, every_document=True),
    "B12_extract_section_strict": _with(
        [DOC, STRICT_CUT, STRICT_EXT],
        """SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'section_not_found' END AS status, reason,
  CASE WHEN reason IS NULL THEN content END AS content_html, strlen(content) AS content_length FROM ext""",
    ),
    "J1_ticker_cik": _with(
        [REG, REQ, RES],
        "SELECT request_id, lookup_status, CASE WHEN k IS NOT NULL THEN printf('%010d', k) END AS cik FROM res",
    ),
    "J2_company_filings": _with(
        [REG, REQ, RES, FIL, IDX],
        """SELECT r.request_id, printf('%010d', r.k) AS cik, s.page,
  CASE WHEN s.k IS NULL OR s.k % 79 = 2 THEN 'http_error' ELSE 'ok' END AS listing_status
FROM res r LEFT JOIN (SELECT DISTINCT k, page FROM idx) s ON s.k = r.k WHERE r.lookup_status = 'ok'""",
    ),
    "O1_newest_first": _with(LISTING, "SELECT request_id, accession AS accession_number, filing_rank FROM lst"),
    "R1_request_gate": _with([REG, REQ, RES, FIL, IDX, GATE], "SELECT request_id, request_status FROM gate"),
    "R2_filing_outcome": _with(
        OUTCOME,
        """SELECT request_id, accession AS accession_number, status,
  CASE WHEN status = 'section_not_found' THEN reason0 END AS reason,
  CASE WHEN status IN ('ok', 'section_not_found') THEN strlen(content) END AS content_length, url FROM outc""",
    ),
    "R3_run_summary": _with(
        [*OUTCOME, SUM], "SELECT request_id, request_status, success_count, failure_count FROM tot"
    ),
    "R4_all_failed": _with(
        [*OUTCOME, SUM],
        """SELECT request_id, success_count = 0 AND failure_count > 0 AS all_failed,
  (success_count = 0 AND failure_count > 0) OR request_status <> 'ok' AS run_failed FROM tot""",
    ),
    "K1_section_sink": _with(
        [*OUTCOME, LAST],
        """SELECT ticker, year AS filing_year, company_name, 'Item 8' AS section_name,
  'Financial Statements and Supplementary Data' AS section_title, content AS content_html,
  ticker || '_' || CAST(year AS VARCHAR) || '_Item8.html' AS file_name FROM last""",
    ),
    "K2_metadata_sink": _with(
        [*OUTCOME, LAST],
        """SELECT '{"ticker":"' || ticker || '","company_name":"' || company_name || '","filing_year":' || CAST(year AS VARCHAR) ||
  ',"section_name":"Item 8","section_title":"Financial Statements and Supplementary Data","content_length":' ||
  CAST(strlen(content) AS VARCHAR) || '}' AS record,
  ticker || '_' || CAST(year AS VARCHAR) || '_Item8_meta.json' AS file_name FROM last""",
    ),
    "K3_last_write_wins": _with(
        [*OUTCOME, LAST],
        "SELECT ticker, year AS filing_year, company_name, accession AS accession_number FROM last",
    ),
    "K4_failure_sink": _with(
        OUTCOME,
        """SELECT ticker, year AS filing_year, request_id, accession AS accession_number, reason0 AS reason,
  'Failed to extract Item 8 for ' || ticker || ' ' || CAST(year AS VARCHAR) || ': Section not found: ' ||
  CASE WHEN reason0 = 'below_min'
    THEN 'Item 8 found but size ' || CAST(strlen(content) AS VARCHAR) || ' bytes is less than minimum 1000 bytes'
    ELSE 'Could not find valid start/end boundaries for Item 8 in DOM for ' || ticker || '-' || CAST(year AS VARCHAR) END
  || chr(10) || 'URL: ' || url || chr(10) AS failure_text
FROM outc WHERE status = 'section_not_found'""",
    ),
    "K5_raw_sink": _with(
        [*LISTING, DOC],
        f"""SELECT DISTINCT l.ticker, l.year AS filing_year, l.accession AS accession_number, {MARKUP} AS html
FROM lst l JOIN doc d ON {LINK.format(order="l", doc="d")} WHERE d.http_status = 200""",
    ),
    "D1_regex_spans": _with([SPANS], "SELECT doc_id, span_end - n_bytes AS span_start, span_end, kind FROM span"),
    "D2_annotate": _with(
        [
            SPANS,
            """prev AS (
  SELECT *, span_end - n_bytes AS span_start,
    coalesce(lag(char_end) OVER (PARTITION BY doc_id ORDER BY span_end - n_bytes, pattern_no), 0) AS char_prev
  FROM span)""",
            """body AS (
  SELECT doc_id, max(char_end) AS last_end,
    string_agg(substr(text, char_prev + 1, greatest(char_end - n_chars - char_prev, 0)) || '<span class="highlight-' ||
      CASE WHEN kind IN ('start', 'end', 'item8', 'item9') THEN kind ELSE 'custom' END || '" title="Position: ' ||
      CAST(span_start AS VARCHAR) || '-' || CAST(span_end AS VARCHAR) || ', Type: ' || kind || '">' || hit || '</span>', ''
      ORDER BY span_start, pattern_no) AS marked
  FROM prev GROUP BY doc_id)""",
        ],
        f"""SELECT d.doc_id, {SHELL} || coalesce(b.marked, '') || substr(d.text, coalesce(b.last_end, 0) + 1) ||
  chr(10) || '</body>' || chr(10) || '</html>' AS annotated
FROM documents d LEFT JOIN body b ON b.doc_id = d.doc_id""",
    ),
}
