"""Removal of long byte strings that occur twice, with a logarithmic family of sampled suffix arrays.

Each string of ``LENGTH`` bytes points at one of the suffixes that start inside it, the one whose first ``HEAD``
bytes have the least fingerprint; equal strings point at the same place.  Only these suffixes, about one in 170, are
indexed.  A batch of documents gets the sorted array of its suffix heads; it is merge-scanned against itself and against
every level that exists, which yields the heads that occur twice; then it becomes a level, and levels of equal size
merge.  What a suffix stands for, the run of strings that point at it, is compared exactly afterwards: equal runs by
count, runs that share only the head string by string.

Defined cases: a null text is empty; a text of fewer bytes than ``LENGTH`` loses nothing; null ids are ids; rows that
repeat are two places, so all their strings repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import stored, text_or_empty

LENGTH = 400
HEAD = 64
#: Batches a table is dealt into.
BATCHES = 4
#: Bytes of a text handled at a time.
STEP = 1 << 20
#: Runs with one head, of at most 800 bytes each, that are compared in one task's memory; heads with more are compared
#: by shuffled string fingerprints.
GROUP = 8192
#: Keys of affected documents are broadcast up to this many; beyond, Spark picks a shuffled join.
BROADCAST_KEYS = 1_000_000

KEY = ["id", "text_hash"]
NULL_ID = -(1 << 63)


def _windows(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[:-rest], out[rest:]) if rest else out


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and the inverse powers that turn a difference into a fingerprint."""
    up, down = tokens.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def sampled(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """``head, run, at, low, high`` of each sampled suffix of ``data``: fingerprints of the head and of the whole run,
    the suffix' position and the first and last position whose string points at it."""
    n = len(data) - LENGTH + 1
    width = LENGTH - HEAD + 1
    total, down = _prefix(data)
    m = len(data) - HEAD + 1
    heads = tokens.mixed((total[HEAD:] - total[:m]) * down[:m])
    least = _windows(heads, width, np.minimum)
    # a head is sampled if it is the least of some string; strings off the ends count as none
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(_windows(padded, width, np.maximum) == heads)
    changes = np.flatnonzero(least[1:] != least[:-1]) + 1
    begins = np.unique(np.concatenate([[0], changes, places + 1]))
    begins = begins[begins < n]
    # the string at `begin` points at the first sampled place from there on that has its least head
    kinds, kind = np.unique(heads[places], return_inverse=True)
    order = np.argsort(kind, kind="stable")
    base = np.int64(len(data) + 1)
    sorted_key = kind[order].astype(np.int64) * base + places[order]
    asked = np.searchsorted(kinds, least[begins]).astype(np.int64) * base + begins
    at = places[order][np.searchsorted(sorted_key, asked)]
    new = np.concatenate([[True], at[1:] != at[:-1]])
    low, at = begins[new], at[new]
    high = np.concatenate([low[1:] - 1, [n - 1]])
    whole = (total[high + LENGTH] - total[low]) * down[low] + (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return heads[at], tokens.mixed(whole), at, low, high


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text in steps that overlap so that each string lies in exactly one."""
    for start in range(0, max(len(data) - LENGTH + 1, 0), STEP):
        yield start, data[start : start + STEP + LENGTH - 1]


def _sources(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
        F.col("doc_id"),
        text_or_empty().alias("text"),
    )


def suffixes(sources: DataFrame) -> DataFrame:
    """``id, text_hash, head, run, at, low, high``: the sampled suffixes of all texts."""
    schema = "id bigint, text_hash bigint, head bigint, run bigint, at int, low int, high int"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in tokens.text_batches(batches):
                data, offsets = tokens.flat(batch.column("text"))
                owner, columns = [], [[] for _ in range(5)]
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    for start, piece in _pieces(data[a:b]):
                        found = sampled(piece)
                        owner.append(np.full(len(found[0]), i))
                        for k, x in enumerate(found):
                            columns[k].append(x + start if k > 1 else x)
                if not owner:
                    continue
                rows = pa.array(np.concatenate(owner))
                out = [np.concatenate(c) for c in columns]
                arrays = [batch.column("id").take(rows), batch.column("text_hash").take(rows)]
                arrays += [pa.array(x.view(np.int64)) for x in out[:2]] + [pa.array(x.astype(np.int32)) for x in out[2:]]
                yield pa.record_batch(arrays, names=[*KEY, "head", "run", "at", "low", "high"])

    return sources.select(*KEY, "text").filter(F.octet_length("text") >= LENGTH).mapInArrow(sample, schema)


class LevelFamily:
    """Sorted arrays of suffix heads; level ``i`` holds ``2^i`` batches and at most one array."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch's suffixes; returns its heads that occur twice, in the batch or against a level."""
        counted = batch.groupBy("head").agg(F.count("*").alias("n"))
        array = stored(counted.sortWithinPartitions("head"), "suffix_array")
        twice = array.filter("n > 1").select("head")
        for level in self.levels.values():  # both sides sorted by head: a merge scan
            twice = twice.unionByName(array.select("head").join(level.hint("merge"), "head", "left_semi"))
        found = stored(twice, "suffix_matches")
        size = 0
        while size in self.levels:
            merged = self.levels.pop(size).unionByName(array.select("head")).distinct()
            array = stored(merged.sortWithinPartitions("head"), "suffix_level")
            size += 1
        self.levels[size] = array.select("head")
        return found


def _string_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all ``LENGTH``-byte strings of the texts and the number of each text's."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    total, down = _prefix(data)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - LENGTH + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return tokens.mixed((total[at + LENGTH] - total[at]) * down[at]), counts


def _ranges(marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked strings: the text they are in, their first and last string in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    local = np.arange(len(marks)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    before = np.concatenate([[False], marks[:-1]]) & (local > 0)
    after = np.concatenate([marks[1:], [False]]) & (local < counts[owner] - 1)
    first, last = np.flatnonzero(marks & ~before), np.flatnonzero(marks & ~after)
    return owner[first], local[first], local[last]


def _compare(runs: DataFrame) -> DataFrame:
    """``id, text_hash, low, high``: byte spans of repeated strings among runs with the same head.

    Runs come sorted by head; all heads of a batch are compared at once and the last one waits for the next batch.
    """

    def repeated(part: pa.Table) -> pa.RecordBatch:
        prints, counts = _string_prints(part.column("bytes").to_pylist())
        heads = np.repeat(part.column("head").to_numpy().view(np.uint64), counts)
        _, kind, n = np.unique(tokens.mixed(heads) + prints, return_inverse=True, return_counts=True)
        owner, first, last = _ranges(n[kind] > 1, counts)
        low = part.column("low").to_numpy()[owner]
        keys = [part.column(c).combine_chunks().take(pa.array(owner)) for c in KEY]
        spans = [pa.array((low + first).astype(np.int32)), pa.array((low + last + LENGTH).astype(np.int32))]
        return pa.record_batch([*(k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys), *spans], names=[*KEY, "low", "high"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            waiting = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table if waiting is None else pa.concat_tables([waiting, table])
                heads = table.column("head").to_numpy()
                last = int(np.searchsorted(heads, heads[-1])) if len(heads) else 0
                for start, stop in _cuts(heads[:last]):
                    yield repeated(table.slice(start, stop - start))
                waiting = table.slice(last)
            if waiting is not None and waiting.num_rows:
                yield repeated(waiting)

    dealt = runs.select("head", *KEY, "low", "bytes").repartition("head").sortWithinPartitions("head")
    return dealt.mapInArrow(compare, "id bigint, text_hash bigint, low int, high int")


def _cuts(heads: np.ndarray, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Stretches of about ``rows`` rows that do not split a head."""
    start = 0
    while start < len(heads):
        stop = min(start + rows, len(heads))
        stop = len(heads) if stop == len(heads) else int(np.searchsorted(heads, heads[stop - 1], side="right"))
        yield start, stop
        start = stop


def _compare_shuffled(runs: DataFrame) -> DataFrame:
    """The same for heads with very many runs: string fingerprints are counted with partial sums."""

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    prints, counts = _string_prints(part.column("bytes").to_pylist())
                    rows = pa.array(np.repeat(np.arange(part.num_rows), counts))
                    local = np.concatenate([np.arange(c) for c in counts])
                    low = part.column("low").to_numpy()[rows.to_numpy()] + local
                    yield pa.record_batch(
                        [part.column("head").take(rows), part.column("id").take(rows), part.column("text_hash").take(rows), pa.array(prints.view(np.int64)), pa.array(low.astype(np.int32))],
                        names=["head", *KEY, "print", "low"],
                    )

    strings = runs.mapInArrow(prints_of, "head bigint, id bigint, text_hash bigint, print bigint, low int")
    twice = strings.groupBy("head", "print").count().filter("count > 1").select("head", "print")
    hit = strings.join(twice, ["head", "print"])
    return hit.select(*KEY, "low", (F.col("low") + LENGTH).alias("high"))


def _of_heads(frame: DataFrame, heads: DataFrame, how: str) -> DataFrame:
    """``frame`` joined by ``head`` to an aggregate that is a table first: beside a plain table Spark parts the rows of a
    very common head over several tasks (adaptive skew joins), beside an aggregate it may not."""
    return frame.join(stored(heads, "suffix_heads"), "head", how)


def _only(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return frame.join(keys, KEY, how)


def repeated_spans(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``id, text_hash, low, high``: byte spans that together cover what occurs twice (they may overlap)."""
    sources = _sources(documents)
    every = stored(suffixes(sources).withColumn("batch", F.pmod("text_hash", F.lit(batches))), "suffixes")
    family = LevelFamily()
    heads = None
    for number in range(batches):
        found = family.add(every.filter(F.col("batch") == number))
        heads = found if heads is None else heads.unionByName(found)
    matched = stored(_of_heads(every, heads.distinct(), "left_semi").drop("batch"), "suffix_candidates")

    place = F.struct(*KEY, "low", "high")
    runs = matched.groupBy("head", "run").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    runs = stored(runs, "suffix_runs")
    whole = matched.join(runs.filter("n > 1").select("head", "run"), ["head", "run"], "left_semi").select(
        *KEY, "low", (F.col("high") + LENGTH).alias("high")
    )
    sizes = runs.groupBy("head").agg(F.count("*").alias("parts")).filter("parts > 1")
    asked = _of_heads(runs, sizes, "inner").select("head", "parts", "n", "place.*")
    by_text = asked.groupBy(*KEY).agg(F.collect_list(F.struct("head", "parts", "n", "low", "high")).alias("asked"))
    by_text = stored(by_text, "suffix_asked")
    keys = by_text.select(*KEY)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = _only(sources.select(*KEY, "text"), keys, "left_semi").dropDuplicates(KEY).join(by_text, KEY)
    raw = texts.select(*KEY, F.col("text").cast("binary").alias("raw"), "asked")
    cut = raw.select(
        *KEY,
        F.inline(F.expr(f"transform(asked, a -> struct(a.head as head, a.parts as parts, a.low as low, substring(raw, a.low + 1, a.high - a.low + {LENGTH}) as bytes))")),
    )
    cut = stored(cut, "suffix_runs_bytes")
    partly = _compare(cut.filter(F.col("parts") <= GROUP)).unionByName(_compare_shuffled(cut.filter(F.col("parts") > GROUP)))
    return whole.unionByName(partly)


def _digest(frame: DataFrame) -> DataFrame:
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lows, highs in zip(batch.column("text").to_pylist(), batch.column("lows").to_pylist(), batch.column("highs").to_pylist(), strict=True):
                raw, kept, at, removed, spans, reach = text.encode(), [], 0, 0, 0, -1
                for low, high in sorted(zip(lows, highs, strict=True)):
                    if low > reach:
                        kept.append(raw[at:low])
                        spans += 1
                        removed += high - low
                        at = reach = high
                    elif high > reach:
                        removed += high - reach
                        at = reach = high
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            n_bytes, n_removed, n_spans, sha, rest = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(sha, pa.string()), pa.array(rest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return frame.select("doc_id", "text", "lows", "highs").mapInArrow(digest, schema)


def deduplicate(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: a row per document and what stays of it (bytes that
    no longer form a character are left out of ``kept``, not of its hash)."""
    spans = stored(
        repeated_spans(documents, batches).groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("spans")), "suffix_spans"
    )
    keys = spans.select(*KEY)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    sources = _sources(documents)
    clean = _only(sources, keys, "left_anti").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.col("text").alias("kept"),
    )
    hit = _only(sources, keys, "left_semi").join(spans, KEY).select("doc_id", "text", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    return clean.unionByName(_digest(hit))
