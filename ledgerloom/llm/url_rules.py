"""URL filters with DataFrame functions only.

Every rule has a regular expression and the literal tokens that each fitting URL must contain.  A rule is indexed
under whichever of its tokens is rarest among the URLs at hand; the tokens of a URL fetch its candidate rules, and
only these run their expressions.  A rule without literal tokens is a candidate for every URL.

Verdict: of the fitting site rules the longest decides; without one, a fitting pattern rule blocks; else the URL is
allowed.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is allowed; equal URLs are
judged once and repeated rows each get that verdict; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ascii_lower, inline_rows

#: The rule index is broadcast up to this many entries; beyond, Spark picks a shuffled join.
BROADCAST_RULES = 100_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is shown for site rules; ``pattern`` runs over host plus path; ``tokens`` must all occur in it."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    site: bool


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains and a path prefix.  The last path segment may go on, so it is no token."""
    closed = host + path[: path.rfind("/") + 1]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, pattern, tuple(re.findall(TOKEN, closed.lower())), verdict, True)


def word_rule(*words: str) -> Rule:
    """Blocks where the words follow each other as whole tokens of host or path."""
    joined = "[^a-z0-9]+".join(map(re.escape, words))
    return Rule("-".join(words), rf"(?i)(?:^|[^a-z0-9]){joined}(?:$|[^a-z0-9])", words, "block", False)


SITE_RULES = (
    site_rule("org", "/", "allow"),
    site_rule("example.org", "/es/", "block"),
    site_rule("example.org", "/en/1", "block"),
    site_rule("com", "/fr/", "allow"),
    site_rule("com", "/de/", "block"),
)
#: Unwanted kinds of sites, as token sequences.
PATTERN_RULES = tuple(
    word_rule(*words.split())
    for words in (
        "free bets", "online casino", "casino", "poker", "jackpot", "slots", "sportsbook", "betting",
        "adult videos", "xxx", "porn", "sex cams", "hot singles",
        "cheap pills", "buy pills", "viagra", "cialis", "replica watches",
        "payday loans", "free money", "get rich", "crypto giveaway",
        "free download crack", "warez", "keygen", "torrent", "phishing", "malware",
    )
)
RULES = SITE_RULES + PATTERN_RULES


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``."""
    spark = pages.sparkSession
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = split.filter("host != '' or path != ''").select("host", "path").distinct()
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", F.lit("/"), "path")), F.lit(TOKEN), F.lit(0)))
    held = sites.select("host", "path", F.explode(F.concat(F.array(F.lit("")), tokens)).alias("token"))
    listed = inline_rows(
        spark,
        "number int, name string, pattern string, verdict string, site boolean, token string",
        [(i, r.name, r.pattern, r.verdict, r.site, t) for i, r in enumerate(rules) for t in (r.tokens or ("",))],
    )
    if len(rules) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    seen = held.join(F.broadcast(listed.select("token").distinct()) if len(rules) <= BROADCAST_RULES else listed.select("token").distinct(), "token")
    counts = seen.groupBy("token").agg(F.count("*").alias("seen"))
    index = (
        listed.join(counts, "token", "left")
        .groupBy("number")
        .agg(F.min_by(F.struct("token", "name", "pattern", "verdict", "site"), F.struct(F.coalesce("seen", F.lit(0)), "token")).alias("r"))
        .select("number", "r.*")
    )
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = held.join(index, "token").filter(F.expr("rlike(concat(host, path), pattern)"))
    judged = fits.groupBy("host", "path").agg(
        F.max_by(F.when(F.col("site"), F.col("name")), F.when(F.col("site"), F.struct(F.length("name"), "name"))).alias("rule"),
        F.max_by(F.when(F.col("site"), F.col("verdict")), F.when(F.col("site"), F.struct(F.length("name"), "name"))).alias("site_verdict"),
        F.max(~F.col("site")).alias("unwanted"),
    )
    verdict = F.coalesce("site_verdict", F.when(F.col("unwanted"), F.lit("block")), F.lit("allow"))
    return split.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
