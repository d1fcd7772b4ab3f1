"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    importance_resampling,
    mixing,
    ngram_join,
    ngram_lm,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    token_alignment,
    toxicity,
    url_rules,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"), k=4, percent=85)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"))
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, "groups_sha256")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_ngram_lm": op7_ngram_lm,
    "op8_url_rules": op8_url_rules,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_toxicity": op11_toxicity,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^ \t\n\x0B\f\r]+"
_NORMAL = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP1_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_NORMAL} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM doc, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, place.n, item_id FROM place JOIN gram USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN held USING (doc_id)
"""


def _op8_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.name)}, {quote(r.pattern)}, {quote(r.verdict)}, {str(r.site).lower()})" for r in url_rules.RULES)
    host = _LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    return f"""
WITH split AS (SELECT row_number() OVER () AS n, page_id, {host} AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(name, pattern, verdict, site) AS (VALUES {values}),
fit AS (SELECT n, name, verdict, site FROM split, rules WHERE host || path <> '' AND regexp_matches(host || path, pattern)),
best AS (SELECT n, arg_max(name, length(name)) FILTER (site) AS rule, arg_max(verdict, length(name)) FILTER (site) AS verdict,
                bool_or(NOT site) AS unwanted FROM fit GROUP BY n)
SELECT page_id, host, path, rule, coalesce(best.verdict, CASE WHEN unwanted THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (n)
"""


def _op9_sql() -> str:
    stops = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality_rules.STOP_WORDS)
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPACED}') AS w,
               list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS lines FROM doc),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       coalesce(rep.n, 0) AS n_repeat_words,
       len(list_intersect(list_distinct(w), [{stops}])) AS n_stop_words
  FROM cut LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {quality_rules.compiled()} END AS kept
FROM judged
"""


OP10_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM doc UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sized USING (doc_id) GROUP BY doc_id
"""

#: CRC-32 from its definition: 256 remainders, then the bytes of every distinct word one by one.
OP13_SQL = f"""
WITH RECURSIVE bits(b, k, r) AS (
  SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM bits WHERE k < 8),
remainders AS (SELECT list(r ORDER BY b) AS t FROM bits WHERE k = 8),
doc AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
word AS (SELECT unnest(w) AS w FROM doc UNION SELECT unnest({_NORMAL}) FROM benchmark),
byte AS (SELECT w, unnest(range(1, len(hex(encode(w))), 2)) AS i, hex(encode(w)) AS h FROM word),
bytes AS (SELECT w, list(CAST(instr('0123456789ABCDEF', h[i]) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 17 AS UBIGINT) ORDER BY i) AS l FROM byte GROUP BY w),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, l), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS k
           FROM bytes, remainders),
source AS (SELECT k, count(*) AS s FROM (SELECT unnest(w) AS w FROM doc) JOIN bucket USING (w) GROUP BY k),
wanted AS (SELECT k, count(*) AS t FROM (SELECT unnest({_NORMAL}) AS w FROM benchmark) JOIN bucket USING (w) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM source) + 10000 AS DOUBLE)
                / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM wanted) + 10000 AS DOUBLE)))) AS g
         FROM source LEFT JOIN wanted USING (k)),
row_ AS (SELECT row_number() OVER () AS n, doc_id, w FROM doc),
weighed AS (SELECT n, floor(sum(g) / count(*)) AS weight FROM (SELECT n, unnest(w) AS w FROM row_) JOIN bucket USING (w) JOIN gain USING (k) GROUP BY n),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
           FROM row_ LEFT JOIN weighed USING (n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op8_url_rules": _op8_sql(),
    "op9_quality_rules": _op9_sql(),
    "op10_ngram_join": OP10_SQL,
    "op13_importance_resampling": OP13_SQL,
}
