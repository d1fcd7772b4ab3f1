"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a domain-language-source tree by weight.  Where a branch cannot supply its share (at most
``max_epochs`` passes over its tokens), the shortage goes to its siblings by weight, and only what a whole family
cannot supply moves up to the family's siblings.  A leaf takes whole epochs and then a prefix, in tokens, of one more
epoch, each epoch in an order seeded by its number.

Defined cases: null domain, language or source is the branch ''; a null or empty text has no tokens and is taken in
every whole epoch and in the prefix where its turn comes; repeated rows are separate rows with equal order keys; an
empty table gives no rows; a tree that cannot supply the budget gives all it has; a weight of 0 or less takes nothing.
Only id, text and the three tree columns are read, other columns ride along in ``mix_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import inline_rows, stored, text_or_empty

#: Bits of an order key that cut a leaf into pieces for its running token count.
PIECE_BITS = 10


def default_domain() -> Column:
    """Domains of the test tables' sources, by source number."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(number < 8, "web").when(number < 14, "books").when(number < 20, "reference").otherwise("other")


@dataclass(frozen=True)
class Weights:
    """Weights by path: ``("web",)``, ``("web", "en")``, ``("web", "en", "src1")``; unnamed branches weigh 1."""

    by_path: Mapping[tuple[str, ...], float] = field(default_factory=dict)

    def of(self, path: tuple[str, ...]) -> float:
        return max(0.0, float(self.by_path.get(path, 1.0)))


#: Targets of the registered query.
TARGETS = Weights(
    {
        ("web",): 0.5, ("books",): 0.3, ("reference",): 0.2, ("other",): 0.05,
        ("web", "en"): 0.5, ("web", "de"): 0.2, ("web", "fr"): 0.2, ("web", "es"): 0.1,
        ("web", "en", "src0"): 2.0,
    }
)


def exact(number: float) -> Fraction | float:
    """The number as it is written, so that no budget is a rounding step short of what its leaf holds."""
    return number if isinstance(number, Fraction) or math.isinf(number) else Fraction(repr(float(number)))


def share(amount: Fraction, weights: list[float], limits: list[Fraction]) -> list[Fraction]:
    """``amount`` by weight, none above its limit; what one cannot take goes to the others by weight."""
    given, weights = [Fraction(0)] * len(weights), [exact(w) for w in weights]
    free = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    rest = min(amount, sum(limits[i] for i in free))
    while free and rest > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / total >= limits[i]]
        if not full:
            for i in free:
                given[i] = rest * weights[i] / total
            break
        for i in full:
            given[i] = limits[i]
        rest -= sum(limits[i] for i in full)
        free = [i for i in free if i not in full]
    return given


def budgets(supply: dict[tuple[str, ...], int], weights: Weights, amount: float, max_epochs: float) -> dict[tuple[str, ...], Fraction]:
    """Tokens to take from each leaf."""
    epochs = exact(max_epochs)

    def limit(path: tuple[str, ...]) -> Fraction:
        """What a branch can give; a branch without weight gives nothing."""
        if path in supply:
            return supply[path] * epochs
        return sum(limit(c) for c in children.get(path, ()) if weights.of(c) > 0)

    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for leaf in supply:
        for depth in range(len(leaf)):
            family = children.setdefault(leaf[:depth], [])
            if leaf[: depth + 1] not in family:
                family.append(leaf[: depth + 1])
    out: dict[tuple[str, ...], Fraction] = {}

    def descend(path: tuple[str, ...], given: Fraction) -> None:
        if path in supply:
            out[path] = given
            return
        family = sorted(children.get(path, ()))
        parts = share(given, [weights.of(c) for c in family], [limit(c) for c in family])
        for child, part in zip(family, parts, strict=True):
            descend(child, part)

    descend((), exact(amount))
    return out


def mix(
    documents: DataFrame,
    weights: Weights = TARGETS,
    fraction: float = 0.5,
    max_epochs: float = 4.0,
    seed: int = 17,
    domain: Column | None = None,
) -> DataFrame:
    """``doc_id, text_hash, domain, lang, source, n_tokens, epoch``: a row for each time a document is taken.

    ``fraction`` is the budget as a part of all tokens.  The leaves' totals (one row a leaf) pass through the driver.
    """
    domain = default_domain() if domain is None else domain
    rows = stored(
        documents.select(
            "doc_id",
            F.xxhash64(text_or_empty()).alias("text_hash"),
            F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.regexp_count(text_or_empty(), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n_tokens"),
        ),
        "mix_rows",
    )
    leaf = ["domain", "lang", "source"]
    supply = {(r["domain"], r["lang"], r["source"]): r["n"] for r in rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("n")).collect()}
    wanted = budgets(supply, weights, fraction * sum(supply.values()), max_epochs)
    plan = []
    for path, tokens in wanted.items():
        whole = int(tokens // supply[path]) if supply[path] else 0
        plan.append((*path, whole, int(tokens - whole * supply[path])))
    plan_rows = inline_rows(rows.sparkSession, "domain string, lang string, source string, whole int, rest bigint", plan)
    keyed = rows.join(plan_rows, leaf).withColumn("_order", F.xxhash64(F.lit(seed), "whole", "doc_id", "text_hash"))
    keyed = keyed.withColumn("_piece", F.shiftright("_order", 64 - PIECE_BITS))
    # running tokens over the bounded pieces of a leaf, then over the rows of the one piece that holds the cut
    pieces = keyed.groupBy(*leaf, "_piece").agg(F.sum("n_tokens").alias("_tokens"))
    run = f"sum(_tokens) over (partition by {', '.join(leaf)} order by _piece rows between unbounded preceding and current row)"
    reached = pieces.select(*leaf, "_piece", F.expr(run).alias("_through"), "_tokens")
    placed = keyed.join(reached, [*leaf, "_piece"]).withColumn("_below", F.col("_through") - F.col("_tokens"))
    whole_in = placed.filter("_through <= rest")
    crossing = placed.filter("_through > rest and _below <= rest").withColumn(
        "_sum",
        F.expr(f"_below + sum(n_tokens) over (partition by {', '.join(leaf)}, _piece order by _order, doc_id rows between unbounded preceding and current row)"),
    )
    columns = ["doc_id", "text_hash", *leaf, "n_tokens"]
    last = whole_in.select(*columns, F.col("whole").alias("epoch")).unionByName(
        crossing.filter("_sum <= rest").select(*columns, F.col("whole").alias("epoch"))
    )
    full = keyed.filter("whole > 0").select(*columns, F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"))
    return full.unionByName(last)


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, all columns, each as often as it is taken."""
    taken = mix(documents, **options).groupBy("doc_id", "text_hash").count()
    held = documents.select(
        F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_hash")
    )
    # repeated rows share one key: `count` copies are spread over its `rows` rows by number
    taken = taken.select(F.col("doc_id").alias("_tid"), F.col("text_hash").alias("_thash"), "count")
    joined = held.join(taken, held["_id"].eqNullSafe(taken["_tid"]) & (held["_hash"] == taken["_thash"]))
    numbered = joined.withColumn("_n", F.expr("row_number() over (partition by _id, _hash order by _id)")).withColumn(
        "_of", F.expr("count(*) over (partition by _id, _hash)")
    )
    times = "cast(count div _of + cast(_n <= count % _of as bigint) as int)"
    return numbered.select("_doc", F.explode(F.expr(f"array_repeat(1, {times})"))).select("_doc.*")
