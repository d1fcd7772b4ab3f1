"""Toxicity classifier, regularised by counterfactuals.

A logistic model over hashed words and word beginnings of whole texts.  Words that name a group of people occur in
abuse, and a plain fit holds the name against every text that mentions the group.  So each labelled text with such a
term gets a twin in which the terms are swapped for others of their group, and the fit pays for every change of score
between the two: what only the name tells counts for nothing, what stands around it keeps its weight.

Training uses a bounded sample of labelled rows (``SAMPLE``, those with the smallest hashes of the id); everything after
the fit reads every whole text.  Of the features only those seen in several toxic texts, and more often than chance has
it, are weighed; they are counted in the tasks and summed by feature.

Defined cases: a null or empty text has no features and scores by the intercept; labels without an id or a verdict are
ignored, of several for one id the toxic one counts; without labels of both kinds every text scores the share of toxic
ones (0 without any); rows that repeat an id or text are scored each; a null id is never learned from and counts as
held out; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import stored

#: Labelled rows used for training, at most, and their weighed features, all together.
SAMPLE = 20_000
SAMPLE_FEATURES = 4_000_000
BITS = 22
#: Lengths of word beginnings in bytes; families of word forms share them.
HEADS = (3, 4, 5, 6)
#: A feature is weighed if so many toxic texts hold it and LIFT times as large a share of its texts is toxic as of all.
MIN_TOXIC = 5
LIFT = 2.0
#: Features weighed, at most: those of the most toxic texts.
FEATURES = 1 << 16
STEPS, RATE, LASSO = 250, 0.05, 3e-4
#: Weight of the mean squared change of score under a swap.
SWAP_WEIGHT = 1.0
#: Terms that name groups of people; terms of one line stand for one another.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("american", "mexican", "chinese", "indian", "african", "european", "arab"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
)

_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def features(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows ``text, feature``, each once: words and word beginnings, A-Z folded, without marks around them.

    ``chosen`` (a boolean for every feature) leaves out all others before they are sorted.
    """
    data, offsets = tokens.flat(texts)
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = letter & (np.append(True, ~letter)[: len(letter)] | cut[: len(letter)])
    last = letter & (np.append(~letter, True)[1:] | cut[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    size, mask = ends - starts, np.uint64((1 << BITS) - 1)
    found = []

    def add(rows: np.ndarray, state: np.ndarray, kind: int) -> None:
        column = (tokens.mixed(state + np.uint64(kind)) & mask).astype(np.int64)
        if chosen is not None:
            rows, column = rows[chosen[column]], column[chosen[column]]
        found.append((rows << BITS) | column)

    state = np.zeros(len(starts), np.uint64)
    at = np.arange(len(starts))
    with np.errstate(over="ignore"):
        for i in range(max(HEADS)):
            at = at[size[at] > i]
            byte = tokens.LOWER[data[starts[at] + i]].astype(np.uint64) + np.uint64(1)
            state[at] = tokens.mixed(state[at] * np.uint64(257) + byte)
            if i + 1 in HEADS:
                add(owner[at], state[at], i + 1)
        # a whole word: its bytes as a polynomial, from running sums
        up, down = tokens.powers(len(data) + 1)
        sums = np.append(np.uint64(0), np.cumsum((tokens.LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64))
        add(owner, (sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64), 99)
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & int(mask)


class Swaps:
    """Replaces every identity term by another of its group; which one depends on the text's length only."""

    def __init__(self, groups: tuple[tuple[str, ...], ...]):
        self.places = {term: (g, i) for g, group in enumerate(groups) for i, term in enumerate(group)}
        self.groups = groups
        some = "|".join(sorted(map(re.escape, self.places), key=len, reverse=True))
        self.pattern = re.compile(rf"(?<!\w)(?:{some})(?!\w)", re.IGNORECASE) if some else None

    def swapped(self, text: str | None) -> str | None:
        """The twin, or None where the text has no term."""
        if not text or self.pattern is None or not self.pattern.search(text):
            return None

        def other(found: re.Match) -> str:
            known = self.places.get(found[0].lower())
            if known is None:
                return found[0]
            group = self.groups[known[0]]
            step = 1 + len(text) % (len(group) - 1) if len(group) > 1 else 0
            return group[(known[1] + step) % len(group)]

        return self.pattern.sub(other, text)


@dataclass
class Model:
    columns: np.ndarray
    weights: np.ndarray
    intercept: float

    def __getstate__(self):
        return self.columns, self.weights, self.intercept

    def __setstate__(self, state):
        self.columns, self.weights, self.intercept = state

    @cached_property
    def chosen(self) -> np.ndarray:
        table = np.zeros(1 << BITS, bool)
        table[self.columns] = True
        return table

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, column = features(texts, self.chosen)
        weight = self.weights[np.searchsorted(self.columns, column)] if len(self.columns) else np.zeros(0)
        return _sigmoid(np.bincount(row, weight, len(texts)) + self.intercept)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(weights, intercept, rows, columns, toxic, twin_rows, twin_columns, twin_signs, twins, swap_weight):
    """The mean logistic loss plus ``swap_weight`` times the mean squared change of score under a swap, and its gradient.

    A twin is given by its difference: features that the swap brings (+1) and takes away (-1).
    """
    n = len(toxic)
    p = _sigmoid(np.bincount(rows, weights[columns], n) + intercept)
    value = -np.mean(np.where(toxic == 1, np.log(np.maximum(p, 1e-18)), np.log(np.maximum(1 - p, 1e-18))))
    slope = (p - toxic) / n
    gradient = np.bincount(columns, slope[rows], len(weights))
    if twins and swap_weight:
        change = np.bincount(twin_rows, weights[twin_columns] * twin_signs, twins)
        value += swap_weight * np.mean(change**2)
        gradient += np.bincount(twin_columns, 2 * swap_weight / twins * change[twin_rows] * twin_signs, len(weights))
    return value, gradient, slope.sum()


def fit(rows, columns, toxic, twin_rows, twin_columns, twin_signs, twins: int, width: int, swap_weight: float = SWAP_WEIGHT):
    """Weights and intercept by full-batch adaptive steps on ``loss``, with a lasso on the weights."""
    share = min(max(float(np.mean(toxic)), 1e-6), 1 - 1e-6)
    weights, intercept = np.zeros(width), np.log(share / (1 - share))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        _, gradient, slope = loss(weights, intercept, rows, columns, toxic, twin_rows, twin_columns, twin_signs, twins, swap_weight)
        g = np.append(gradient, slope)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        pace = RATE / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        move = pace * mean / (1 - 0.9**step)
        weights, intercept = weights - move[:-1], intercept - move[-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - np.minimum(pace[:-1], 10.0) * LASSO, 0.0)
    return weights, float(intercept)


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def _lists(row: np.ndarray, column: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(column, pa.int32()))


def sample_features(documents: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, size: int = SAMPLE) -> DataFrame:
    """``at, toxic, columns, twin``: packed features of the sampled texts and, where a text has identity terms, of its twin."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(known), "doc_id")
    kind = "at bigint, toxic int, columns binary, twin binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(terms)
        for batch in tokens.text_batches(batches, 1 << 20):
            twins = [swaps.swapped(t) for t in batch.column("text").to_pylist()]
            some = [i for i, t in enumerate(twins) if t is not None]
            held = tokens.packed_sets(*features(pa.array([twins[i] for i in some], pa.string())), len(some))
            place = dict(zip(some, range(len(some)), strict=True))
            twin = held.take(pa.array([place.get(i) for i in range(batch.num_rows)], pa.int64()))
            own = tokens.packed_sets(*features(batch.column("text")), batch.num_rows)
            yield pa.record_batch([batch.column("at"), batch.column("toxic"), own, twin], names=["at", "toxic", "columns", "twin"])

    return texts.select(F.xxhash64("doc_id", "text").alias("at"), "toxic", "text").mapInArrow(describe, kind)


def chosen_features(sample: DataFrame) -> np.ndarray:
    """The features worth a weight, ``FEATURES`` at most, counted in the tasks and summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            row, values = tokens.unpacked_sets(batch.column("columns"))
            np.add.at(every, values, 1)
            np.add.at(toxic, values[batch.column("toxic").to_numpy()[row] > 0], 1)
        some = np.flatnonzero(every)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(every[some].astype(np.int64)), pa.array(toxic[some].astype(np.int64))], names=["feature", "n", "toxic"])

    share = sample.agg(F.avg("toxic")).first()[0]
    counts = sample.select("toxic", "columns").mapInArrow(count, "feature int, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    good = counts.filter((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= LIFT * float(share) * F.col("n")))
    return np.sort(good.orderBy(F.desc("toxic"), "feature").limit(FEATURES).select("feature").toArrow()["feature"].to_numpy())


def train(documents: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT, size: int = SAMPLE) -> Model:
    """Fit on the bounded sample: executors describe the texts, weighed features meet in one task, weights come back."""
    sample = stored(sample_features(documents, labels, terms, size), "toxic_sample")
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (kinds.get(0) and kinds.get(1)):
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if kinds.get(1) else -40.0)
    columns = chosen_features(sample).astype(np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[columns] = np.arange(len(columns))
        for batch in batches:
            arrays = []
            for name in ("columns", "twin"):
                row, values = tokens.unpacked_sets(batch.column(name))
                at = place[values]
                arrays.append(_lists(row[at >= 0], at[at >= 0], batch.num_rows))
            yield pa.record_batch([batch.column("at"), batch.column("toxic"), *arrays, batch.column("twin").is_valid()], names=["at", "toxic", "columns", "twin", "swapped"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # the sample's weighed features, all in this task
        held = np.cumsum(pc.add(pc.list_value_length(table["columns"]), pc.list_value_length(table["twin"])).to_numpy())
        table = table.slice(0, max(1, int(np.searchsorted(held, SAMPLE_FEATURES, "right"))))
        n, width = table.num_rows, max(len(columns), 1)
        own, twin = (
            np.repeat(np.arange(n), pc.list_value_length(table[c]).to_numpy()) * width + pc.list_flatten(table[c]).to_numpy() for c in ("columns", "twin")
        )
        swapped = table["swapped"].to_numpy(zero_copy_only=False).astype(bool)
        mine = own[swapped[own // width]]
        brought, taken = np.setdiff1d(twin, mine, assume_unique=True), np.setdiff1d(mine, twin, assume_unique=True)
        change, signs = np.concatenate([brought, taken]), np.repeat([1.0, -1.0], [len(brought), len(taken)])
        place = np.cumsum(swapped) - 1
        toxic = table["toxic"].to_numpy().astype(np.int64)
        twins = place[change // width], change % width, signs, int(swapped.sum())
        weights, intercept = fit(own // width, own % width, toxic, *twins, width, swap_weight)
        yield pa.record_batch([pa.array([weights], pa.list_(pa.float64())), pa.array([intercept])], names=["weights", "intercept"])

    rows = sample.mapInArrow(keep, "at bigint, toxic int, columns array<int>, twin array<int>, swapped boolean")
    one = rows.repartition(1).sortWithinPartitions("at").mapInArrow(fit_all, "weights array<double>, intercept double").first()
    weights = np.array(one["weights"])
    used = np.flatnonzero(weights[: len(columns)])
    return Model(columns[used], weights[used], one["intercept"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.text_batches(batches, 1 << 20):
            values = shared.value.scores(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return source.select("doc_id", "text", "held_out").mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT) -> DataFrame:
    return score(documents, train(documents, labels, terms, swap_weight))
