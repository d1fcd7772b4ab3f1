"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered, worst first: 0 harmful, 1 poor, 2 good.  One weight vector over hashed text is shared by all
grades; ordered thresholds turn its score into P(grade > k) = sigmoid(score - threshold_k), so a text has an expected
grade and a tail probability by which it is selected.

Training uses a bounded sample of labelled rows (``SAMPLE``, the smallest hashes of the id, so that it does not depend
on the partitioning); scoring reads every whole text.

Defined cases: a null or empty text has no word features and is scored by its shape alone; labels without a text or
grade are ignored, of several labels of one id the lowest grade counts; without any label every text is kept with
expected grade null; repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Labelled rows used for training, at most, and the bytes read of all of them together.
SAMPLE = 6_000
#: Text bytes the sample may hold in all; rows come in hash order until it is full.
SAMPLE_BYTES = 24 << 20
BITS = 20
GRADES = 3
#: Features seen in fewer sampled texts get no weight; the others pay LASSO for theirs, so that the many plain words of
#: a long text do not add up to a verdict.
MIN_TEXTS = 10
LASSO = 3e-3
STEPS = 300
#: Texts whose P(grade = best) is below are rejected.
KEEP = 0.4
SCHEMA = "doc_id bigint, expected_grade double, p_good double, kept boolean"


def grade() -> F.Column:
    """Graded ratings from the labels: toxic is worst, then low quality."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``row, column, value``: words and word beginnings (presence, damped by length) and shape buckets."""
    data, offsets = tokens.flat(texts)
    starts, ends, prints = tokens.words(data, offsets)
    limits = tokens.word_limits(starts, offsets)
    counts = np.diff(limits)
    owner = np.repeat(np.arange(len(counts)), counts)
    mask = np.uint64((1 << BITS) - 1)
    # the first four bytes of a word, folded: families of word forms share it
    head = np.zeros(len(starts), np.uint64)
    for i in range(4):
        inside = starts + i < ends
        byte = tokens.LOWER[data[np.minimum(starts + i, len(data) - 1)]] if len(data) else np.zeros(0, np.uint8)
        head = head * np.uint64(257) + np.where(inside, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
    word_at = (prints & mask).astype(np.int64)
    head_at = (tokens.mixed(head + np.uint64(1 << 40)) & mask).astype(np.int64)
    key = np.unique(np.concatenate([(owner << BITS) | word_at, (owner << BITS) | head_at]))
    row, column = key >> BITS, key & int(mask)
    value = np.ones(len(key))
    # shape: how much is repeated, how long words are, how much is symbols and short lines
    n = np.maximum(counts, 1)
    repeats = np.zeros(len(prints))
    if len(prints) > 1:
        repeats[1:] = (prints[1:] == prints[:-1]) & (owner[1:] == owner[:-1])
    sums = lambda x: np.bincount(owner, x, len(counts))
    symbol = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))])
    symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]
    measures = [sums(repeats) / n, sums((ends - starts).astype(float)) / n / 10, symbols / n, np.log1p(counts) / 5]
    shape_row, shape_column = [], []
    for m, values in enumerate(measures):
        bucket = np.minimum((values * 10).astype(np.int64), 40)
        shape_row.append(np.arange(len(counts)))
        shape_column.append((tokens.mixed((bucket + 1000 * (m + 1)).astype(np.uint64)) & mask).astype(np.int64))
    shape = np.concatenate(shape_row), np.concatenate(shape_column)
    return np.concatenate([row, shape[0]]), np.concatenate([column, shape[1]]), np.concatenate([value, np.full(len(shape[0]), 3.0)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """``n x (GRADES - 1)``: the probability of a grade above each threshold."""
        score = np.bincount(row, self.weights[column] * value, n)
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, rate: float = 0.05) -> Model:
    """Full-batch adaptive gradient steps on the cumulative-link likelihood, grades weighed evenly.

    Thresholds are kept ordered by fitting the first one and the logarithms of the gaps.
    """
    n = len(grades)
    frequent = np.bincount(column, minlength=1 << BITS) >= MIN_TEXTS
    held = frequent[column]
    row, value = row[held], value[held]
    used, column = np.unique(column[held], return_inverse=True)
    weights = np.zeros(len(used))
    free = np.zeros(GRADES - 1)  # first threshold, then log gaps
    free[0] = -1.0
    count = np.bincount(grades, minlength=GRADES)
    weigh = (n / GRADES / np.maximum(count, 1))[grades]
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(GRADES - 1), np.zeros(GRADES - 1)]
    for step in range(1, STEPS + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(row, weights[column] * value, n)
        tail = _sigmoid(score[:, None] - theta)  # P(grade > k)
        upper = np.hstack([np.ones((n, 1)), tail])[np.arange(n), grades]
        lower = np.hstack([tail, np.zeros((n, 1))])[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-9)
        up_d = np.where(grades > 0, upper * (1 - upper), 0.0)
        low_d = np.where(grades < GRADES - 1, lower * (1 - lower), 0.0)
        d_score = -weigh * (up_d - low_d) / p / n
        d_theta = np.zeros(GRADES - 1)
        np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, weigh * up_d / p / n, 0.0))
        np.add.at(d_theta, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, -weigh * low_d / p / n, 0.0))
        d_free = np.concatenate([[d_theta.sum()], [d_theta[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)]])
        d_weights = np.bincount(column, d_score[row] * value, len(used))
        for x, d, a, b in ((weights, d_weights, state[0], state[1]), (free, d_free, state[2], state[3])):
            a *= 0.9
            a += 0.1 * d
            b *= 0.99
            b += 0.01 * d * d
            pace = rate / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            x -= pace * (a / (1 - 0.9**step))
            if x is weights:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - np.minimum(pace, 10.0) * LASSO, 0.0)
    full = np.zeros(1 << BITS)
    full[used] = weights
    return Model(full, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the bounded sample; its features are made on the executors and meet in one task, ``SAMPLE`` rows at most.
    Only weights come to the driver."""
    graded = labels.select("doc_id", grade().alias("grade")).filter("doc_id is not null and grade is not null")
    chosen = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
    texts = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.withColumn("_first", F.xxhash64("doc_id"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.text_batches(batches):
            row, column, value = features(batch.column("text"))
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(column[order].astype(np.int32)))
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order].astype(np.float32)))
            yield pa.record_batch(
                [batch.column("_first"), batch.column("doc_id"), batch.column("grade"), columns, values],
                names=["_first", "doc_id", "grade", "columns", "values"],
            )

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # ``SAMPLE`` rows at most, all in this task
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = pc.list_value_length(table["columns"]).to_numpy()
        table = table.slice(0, max(1, int(np.searchsorted(np.cumsum(sizes), SAMPLE_BYTES // 8, side="right"))))
        sizes = sizes[: table.num_rows]
        if len(pc.unique(table["grade"])) < 2:
            return
        model = fit(
            np.repeat(np.arange(table.num_rows), sizes),
            pc.list_flatten(table["columns"]).to_numpy().astype(np.int64),
            pc.list_flatten(table["values"]).to_numpy().astype(np.float64),
            table["grade"].to_numpy().astype(np.int64),
        )
        used = np.flatnonzero(model.weights)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((used, pa.int32()), (model.weights[used], pa.float64()), (model.thresholds, pa.float64()))]
        yield pa.record_batch(lists, names=["used", "weights", "thresholds"])

    rows = texts.mapInArrow(sparse, "_first bigint, doc_id bigint, grade int, columns array<int>, values array<float>")
    sample = rows.orderBy("_first", "doc_id").limit(SAMPLE)
    fitted = sample.coalesce(1).mapInArrow(fit_all, "used array<int>, weights array<double>, thresholds array<double>").collect()
    if not fitted:
        return None
    weights = np.zeros(1 << BITS)
    weights[np.array(fitted[0]["used"], np.int64)] = fitted[0]["weights"]
    return Model(weights, np.array(fitted[0]["thresholds"]))


def score(documents: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``doc_id, expected_grade, p_good, kept`` and, where present, ``_row`` to find the row again."""
    extra = [c for c in documents.columns if c == "_row"]
    schema = SCHEMA + "".join(", _row bigint" for _ in extra)
    source = documents.select("doc_id", "text", *extra)
    if model is None:
        return source.selectExpr("doc_id", "cast(null as double) expected_grade", "cast(null as double) p_good", "true kept", *extra)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in tokens.text_batches(batches):
            tail = own.tails(*features(batch.column("text")), batch.num_rows)
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= keep)]
            yield pa.record_batch(arrays + [batch.column(c) for c in extra], names=["doc_id", "expected_grade", "p_good", "kept", *extra])

    return source.mapInArrow(judge, schema)


def classify(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    return score(documents, train(documents, labels), keep)


def select_documents(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns, judged while they pass by."""
    model = train(documents, labels)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    at = documents.columns.index("text")

    def keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in tokens.text_batches(batches):
            tail = own.tails(*features(batch.column(at)), batch.num_rows)
            yield batch.filter(pa.array(tail[:, -1] >= keep))

    return documents.mapInArrow(keep_rows, documents.schema)
