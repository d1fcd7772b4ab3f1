"""Quality rules: a table of thresholds compiled into one projection, evaluated by Spark alone.

Defined cases: a null or empty text has no words, every count is 0 and it fails; texts of any length stay in one row
and are never cut; repeated rows are judged one by one; columns beside id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import text_or_empty

#: Java's \s is exactly space and \t to \r.
WORD = r"[^ \t\n\x0B\f\r]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages; fixed values.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by have from or this not "
    "der die das und ist von zu mit den auf im ein eine nicht sich dem des als auch "
    "el la los las de que y en un una por con para su se no es lo del al "
    "le les du et est dans qui pour pas sur par au ce il ne plus"
).split()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A measure with the closed range in which a text passes; ``None`` leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are SQL over the counts. The ranges are wide: prose passes, markup, tables and word lists do not.
RULES = (
    Rule("mean_word_chars", "word_chars / n_words", 2.0, 25.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.2),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", 2, None),
)

#: Three-word windows as sortable longs, hash above and position below, so that one sort brings equal windows
#: together; sorted neighbours with the same hash count only if their words are equal.  A document in which neighbours
#: with the same hash differ may hold equal windows that are no neighbours, and is sorted by the words instead.
HASH = "xxhash64(w[i], w[i + 1], w[i + 2])"
_NEAR = "filter(sequence(1, size(s) - 1), k -> s[k] - pmod(s[k], size(w)) = s[k - 1] - pmod(s[k - 1], size(w)))"
_SAME = "filter(near, k -> slice(w, int(pmod(s[k], size(w))) + 1, 3) = slice(w, int(pmod(s[k - 1], size(w))) + 1, 3))"
_PLACES = "k -> concat(sequence({0}, {0} + 2), sequence({1}, {1} + 2))"
_HITS = f"flatten(transform(same, {_PLACES.format('pmod(s[k], size(w))', 'pmod(s[k - 1], size(w))')}))"
_BY_WORDS = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'i', bigint(i))))"
_EQUAL = "filter(sequence(1, size(x) - 1), k -> x[k].a = x[k - 1].a and x[k].b = x[k - 1].b and x[k].c = x[k - 1].c)"
_ALL_HITS = f"flatten(transform({_EQUAL}, {_PLACES.format('x[k].i', 'x[k - 1].i')}))"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(hash: str = HASH) -> str:
    """SQL for the number of words inside windows that occur more than once."""
    keys = f"sort_array(transform(sequence(0, size(w) - 3), i -> (shiftright({hash}, 2) div size(w)) * size(w) + i))"
    every = _let("x", _BY_WORDS, f"size(array_distinct({_ALL_HITS}))")
    found = _let("same", _SAME, f"if(size(same) = size(near), size(array_distinct({_HITS})), {every})")
    return f"if(size(words) < 4, 0, {_let('w', 'words', _let('s', keys, _let('near', _NEAR, found)))})"


def counts(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the counts the rules measure, one narrow projection of the text."""
    text = documents.select("doc_id", text_or_empty().alias("text"))
    split = text.select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
    )
    stops = F.array(*[F.lit(w) for word in STOP_WORDS for w in (word, word.capitalize())])
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words()).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect("words", stops)).cast("long").alias("n_stop_words"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """The rule table as one SQL condition."""
    sides = [f"({r.measure}) >= {r.least}" for r in rules if r.least is not None]
    sides += [f"({r.measure}) <= {r.most}" for r in rules if r.most is not None]
    return " and ".join(sides) or "true"


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts plus ``base_failed`` and ``kept``."""
    counted = counts(documents)
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return counted.withColumn("base_failed", F.expr(failed)).withColumn(
        "kept", F.expr(f"case when base_failed then false else {compiled(rules)} end")
    )
