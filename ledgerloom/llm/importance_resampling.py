"""Importance resampling of documents towards a target distribution, over hashed n-grams.

A feature is a run of 1 to ``n`` words, its bucket the CRC-32 of its bytes modulo ``buckets``.  Bucket totals of the
target and of all documents give each bucket a gain (the logarithm of how much more the target holds it, smoothed by one
a bucket); a document's weight is the mean gain of its features, and Gumbel noise seeded by its id turns the weights into
a draw without replacement: the highest scores are drawn.

The vocabulary has a head and a tail.  Of the words of all documents the most frequent, and likewise of the word pairs,
are broadcast: a word with its exact CRC state, from which a run of words is carried on byte by byte, a pair with its
bucket.  Every other feature takes the CRC of its bytes directly.  Both give the same bucket, so the head's size changes
the time and never a result, and both feed the same exact bucket totals.

Gains are whole thousandths, so sums do not depend on the order of the rows.  Ranks need no sort of all rows in one
place: scores are whole numbers, so the rows ahead of a score come from counts by score, and rows of one score are
numbered among themselves.

Defined cases: a null or wordless text has no features and weight 0; documents of fewer than ``min_words`` words are
scored but not drawn, and do not count for the size of the draw; a null id has no noise: score and rank are null and it
does not count either; rows that repeat an id are rows of their own, ties go to the smaller id and then to the text hash;
an empty benchmark gives gains by the documents' totals alone; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .tables import stored

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Part of the documents drawn, in percent.
PERCENT = 10
#: Words, and pairs, of the head; a longer entry than ``HEAD_BYTES`` stays in the tail, so the broadcast is bounded.
HEAD = 20_000
HEAD_BYTES = 40

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x41:0x5B] = _WORD[0x80:] = True


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, A-Z lower-cased, as codes of distinct byte strings, and the limits of each text's."""
    data, offsets = tokens.flat(texts)
    solid = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = np.flatnonzero(solid & (np.append(True, ~solid)[: len(solid)] | cut[: len(solid)]))
    own = tokens.LOWER[data[solid]]
    at = np.append(0, np.cumsum(solid))  # bytes of words before each byte
    ends = np.append(at[first], len(own)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(own)])
    return words.dictionary_encode(), np.searchsorted(first, offsets)


@dataclass
class Head:
    """CRC states of the frequent words and buckets of the frequent pairs."""

    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]

    def state(self, word: bytes) -> int:
        known = self.states.get(word)
        return zlib.crc32(word) if known is None else known


def features(texts: pa.Array, head: Head, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every feature, and each text's number of words."""
    coded, limits = words_of(texts)
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    counts = np.diff(limits)
    owner = np.repeat(np.arange(len(counts)), counts)
    states = np.array([head.state(w) for w in words], np.int64)
    found, of = [states[codes] % buckets if len(words) else codes], [owner]
    run, state = codes, states  # distinct runs so far by code, and their CRC states
    for k in range(2, n + 1):
        inside = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
        key, code = np.unique((run[inside] << 32) | codes[inside + k - 1], return_inverse=True)
        longer = np.zeros(len(key), np.int64)
        bucket = np.zeros(len(key), np.int64)
        for i, (a, b) in enumerate(zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist(), strict=True)):
            known = head.pairs.get((words[a], words[b])) if k == 2 else None
            if known is None or n > 2:  # a longer run goes on from the state
                longer[i] = zlib.crc32(words[b], zlib.crc32(b" ", int(state[a])))
            bucket[i] = longer[i] % buckets if known is None else known
        found.append(bucket[code])
        of.append(owner[inside])
        run = np.zeros(len(owner), np.int64)
        run[inside] = code
        state = longer
    return np.concatenate(found), np.concatenate(of), counts


def vocabulary_head(documents: DataFrame, n: int, buckets: int = BUCKETS, size: int = HEAD) -> Head:
    """About the ``size`` most frequent words, and pairs if ``n`` asks for them: each task counts all it reads and lets
    the rarest go whenever it holds eight times ``size``, so what it holds and sends is bounded whatever it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter()]
        for batch in tokens.text_batches(batches):
            coded, limits = words_of(batch.column("text"))
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            times = np.bincount(codes, minlength=len(words))
            held[0].update(dict(zip(words, times.tolist(), strict=True)))
            if n > 1 and len(codes) > 1:
                owner = np.repeat(np.arange(batch.num_rows), np.diff(limits))
                inside = owner[1:] == owner[:-1]
                key, times = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_counts=True)
                pairs = ((words[k >> 32] + b" " + words[k & 0xFFFFFFFF], t) for k, t in zip(key.tolist(), times.tolist(), strict=True))
                held[1].update(dict(pairs))
            for k, counter in enumerate(held):
                if len(counter) > 8 * size:
                    held[k] = Counter(dict(counter.most_common(size)))
        for k, counter in enumerate(held):
            top = [(w, c) for w, c in counter.most_common(4 * size) if len(w) <= HEAD_BYTES]
            if top:
                yield pa.record_batch([pa.array([k + 1] * len(top), pa.int32()), *map(pa.array, zip(*top, strict=True))], names=["k", "feature", "n"])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k int, feature binary, n bigint")
    counts = parts.groupBy("k", "feature").agg(F.sum("n").alias("n"))
    top = [r for k in range(1, min(n, 2) + 1) for r in counts.filter(f"k = {k}").orderBy(F.desc("n"), "feature").limit(size).collect()]
    words = {bytes(r["feature"]): zlib.crc32(bytes(r["feature"])) for r in top if r["k"] == 1}
    pairs = {tuple(bytes(r["feature"]).split(b" ")): zlib.crc32(bytes(r["feature"])) % buckets for r in top if r["k"] == 2}
    return Head(words, pairs)


def bucket_totals(documents: DataFrame, head, n: int, buckets: int) -> DataFrame:
    """``bucket, n``: exact counts of all features, one partial row per bucket and task."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in tokens.text_batches(batches):
            found, _, _ = features(batch.column("text"), head.value, n, buckets)
            sums += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(total, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, head, n: int, buckets: int) -> DataFrame:
    """``bucket, source, target, gain`` for every bucket: floor(1000 ln of how much denser the target is in it)."""
    spark = documents.sparkSession
    source = bucket_totals(documents, head, n, buckets).withColumnRenamed("n", "source")
    wanted = bucket_totals(target, head, n, buckets).withColumnRenamed("n", "target")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["source", "target"])
    held = stored(held, "bucket_totals")
    all_source, all_target = held.agg(F.sum("source"), F.sum("target")).first()
    ratio = (F.col("target") + 1).cast("double") * F.lit(float(all_source + buckets))
    ratio = ratio / ((F.col("source") + 1).cast("double") * F.lit(float(all_target + buckets)))
    return held.select("bucket", "source", "target", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(documents: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, head_size: int = HEAD) -> DataFrame:
    """``doc_id, n_words, n_features, weight, text_hash`` per document."""
    spark = documents.sparkSession
    head = spark.sparkContext.broadcast(vocabulary_head(documents, n, buckets, head_size))
    table = gains(documents, target, head, n, buckets).orderBy("bucket").toArrow()  # a row per bucket
    shared = spark.sparkContext.broadcast(table["gain"].to_numpy().astype(np.int64))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.text_batches(batches):
            found, of, counts = features(batch.column("text"), head.value, n, buckets)
            sums = np.bincount(of, shared.value[found], batch.num_rows).astype(np.int64)  # whole numbers below 2^53
            size = np.bincount(of, minlength=batch.num_rows)
            weight = np.floor_divide(sums, np.maximum(size, 1))
            columns = [pa.array(x.astype(np.int64)) for x in (counts, size, weight)]
            yield pa.record_batch([batch.column("doc_id"), *columns, batch.column("text_hash")], names=["doc_id", "n_words", "n_features", "weight", "text_hash"])

    text = F.col("text").cast("string")
    source = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(score, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, text_hash bigint")


def resample(
    documents: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    head_size: int = HEAD,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` per document; rank is null where it is not drawn."""
    weighed = weigh(documents, target, n, buckets, head_size)
    scored = weighed.withColumn("score", F.col("weight") + noise(seed))
    scored = stored(scored.withColumn("able", (F.col("n_words") >= min_words) & F.col("score").isNotNull()), "resampling_scores")
    able = scored.filter("able")
    drawn = able.count() * percent // 100
    # scores are whole thousandths within some +-60,000, so this table does not grow with the documents
    downwards = Window.orderBy(F.desc("score"))
    by_score = able.groupBy("score").agg(F.count("*").alias("own"))
    ahead = by_score.select("score", (F.sum("own").over(downwards) - F.col("own")).alias("ahead")).filter(F.col("ahead") < drawn)
    ahead = stored(ahead, "resampling_places")
    least = ahead.agg(F.min("score")).first()[0]
    near = F.coalesce(F.col("able") & (F.col("score") >= F.lit(least)), F.lit(False))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "text_hash"))
    ranked = scored.filter(near).join(F.broadcast(ahead), "score").withColumn("place", place)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).cast("bigint").alias("rank"))
    return ranked.unionByName(scored.filter(~near).select(*columns, F.lit(None).cast("bigint").alias("rank")))
