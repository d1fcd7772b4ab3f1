"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles.  Shingles have one global order, rare ones first, by a sketch
of all documents' shingle counts (ties by fingerprint).  Two sets that are similar enough share at least ``m`` tokens
within their first ``n - overlap + m`` ones; each document picks its own ``m`` so that the estimated cost, entries to
read plus candidates to verify, is least, and a pair must share as many prefix tokens as the smaller ``m`` asks.

Equal sets are one class from the start.  Candidates are verified on the whole texts.  Groups of many near copies need
no pair of all their members: first every member of a token's group is verified against the most central one, and
afterwards only pairs that are not connected yet are looked at, all of them.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; fewer than k words are one
shingle; rows with a null id are never linked and get a null component; rows that repeat an id count as one document;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import tokens
from .components import components
from .tables import stored

#: Counters of the frequency sketch: a fixed size, whatever the corpus.
SKETCH_BITS = 21
SKETCH_ROW = 1 << 12
#: The prefix lengthenings a document may choose from, and the cost of verifying a candidate in entries read.
MATCHES = (1, 2, 3, 4)
VERIFY_COST = 20.0
#: Ids of possible partners are broadcast up to this many; beyond, Spark picks a shuffled join.
BROADCAST_IDS = 1_000_000


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offsets = tokens.flat(texts)
    starts, _, prints = tokens.words(data, offsets)
    values, limits = tokens.shingles(prints, tokens.word_limits(starts, offsets), k)
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        yield np.unique(values[a:b])


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, s1, s2`` per document (equal for equal sets), and rows of sketch counters
    (``chunk, counts``)."""
    schema = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, chunk int, counts array<bigint>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in tokens.text_batches(batches):
            rows, every = [], []
            for values in sets_of(batch.column("text"), k):
                other = tokens.mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                rows.append((len(values), int(values.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))))
                every.append(values)
            sketch += np.bincount((np.concatenate(every) & mask).astype(np.int64), minlength=len(sketch))
            n, s1, s2 = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), n, s1, s2, *nothing], names=["doc_id", "n_shingles", "s1", "s2", "chunk", "counts"])
        chunks = len(sketch) // SKETCH_ROW
        counts = pa.ListArray.from_arrays(pa.array(np.arange(chunks + 1, dtype=np.int32) * SKETCH_ROW), pa.array(sketch))
        empty = [pa.nulls(chunks, pa.int64())] * 4
        yield pa.record_batch([*empty, pa.array(np.arange(chunks, dtype=np.int32)), counts], names=["doc_id", "n_shingles", "s1", "s2", "chunk", "counts"])

    return documents.select("doc_id", "text").mapInArrow(sign, schema)


def frequencies(signed: DataFrame) -> np.ndarray:
    """The summed sketch less what unrelated tokens add to a counter on average."""
    schema = "chunk int, counts array<bigint>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a task holds the chunks dealt to it, one array each
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                values = counts.values.to_numpy()
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        if sums:
            ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * SKETCH_ROW)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(list(sums.values()))))
            yield pa.record_batch([pa.array(list(sums), pa.int32()), lists], names=["chunk", "counts"])

    cells = signed.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
    summed = cells.mapInArrow(add, schema).toArrow()  # 2^SKETCH_BITS counters in all
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW).reshape(-1, SKETCH_ROW)
    for chunk, counts in zip(summed["chunk"].to_pylist(), summed["counts"], strict=True):
        out[chunk] = counts.values.to_numpy()
    out = out.reshape(-1)
    noise = float(np.median(out))
    return np.where(out > noise + 6 * np.sqrt(noise + 1), out - noise, 0.0).astype(np.float32)


def prefixes(documents: DataFrame, seen: np.ndarray, k: int, percent: int) -> DataFrame:
    """``doc_id, n, matches, index_length, tokens``: each document's prefix in the global order."""
    shared = documents.sparkSession.sparkContext.broadcast(seen)
    schema = "doc_id bigint, n bigint, matches int, index_length int, tokens array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in tokens.text_batches(batches):
            kept, n_all, matches, index, ends, parts = [], [], [], [], [0], []
            for i, values in enumerate(sets_of(batch.column("text"), k)):
                n = len(values)
                if not n:
                    continue
                often = counts[(values & mask).astype(np.int64)]
                level = np.where(often > 0, np.log2(often + 1).astype(np.int64) + 1, 0)
                order = np.argsort(level, kind="stable")  # values are sorted already
                probe = n + percent * -n // 100  # n - ceil(percent n / 100)
                least = n + 2 * percent * -n // (100 + percent)
                read = np.cumsum(often[order] + 1)
                choice = min(
                    (m for m in MATCHES if m == 1 or probe + m <= n),
                    key=lambda m: probe + m + (1 + VERIFY_COST / m) * (read[min(probe + m, n) - 1] - probe - m),
                )
                length = min(probe + choice, n)
                kept.append(i)
                n_all.append(n)
                matches.append(choice)
                index.append(min(least + choice, n))
                parts.append(values[order[:length]])
                ends.append(ends[-1] + length)
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))
            )
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(kept, pa.int64()))
            yield pa.record_batch(
                [ids, pa.array(n_all, pa.int64()), pa.array(matches, pa.int32()), pa.array(index, pa.int32()), lists],
                names=["doc_id", "n", "matches", "index_length", "tokens"],
            )

    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole texts are similar enough.  Only the texts of candidates are moved."""
    pairs = stored(pairs, "ngram_pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ngram_ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stored(documents.join(wanted, "doc_id", "left_semi"), "ngram_texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = []
                for x, y in zip(sets_of(part.column("text_a"), k), sets_of(part.column("text_b"), k), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(check, "a bigint, b bigint").distinct()


def _possible(a: str, b: str, percent: int) -> str:
    """Lengths and positions leave room for the overlap that similarity asks for."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
        f"(100 + {percent}) * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * ({a}.n + {b}.n)"
    )


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("component", F.col("doc_id"))
    return entries.join(labels, entries["doc_id"] == labels["id"], "left").withColumn("component", F.coalesce("component", "doc_id")).drop("id")


def _star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Every member of a token's group against the one with the fewest rarer tokens of its own: of near copies that is
    the one closest to what they have in common."""
    first = entries.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "n")).alias("p"))
    joined = entries.alias("e").join(first, "token").filter("e.doc_id != p.doc_id").filter(_possible("e", "p", percent))
    return joined.select(F.col("e.doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct()


def _open_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs not connected yet that may be similar: one side in its shorter index prefix, and in each group never
    two members of its most frequent component.

    Lengths and positions are tested as if the token were the first that the two share, which it is in one group.
    """
    sizes = entries.groupBy("token", "component").agg(F.count("*").alias("count"), F.min("n").alias("least"))
    main = sizes.groupBy("token").agg(
        F.max_by("component", "count").alias("main"), F.count("*").alias("parts"), F.min("least").alias("least")
    ).filter("parts > 1")
    # an entry so far back that even the shortest member of its group is out of reach has no partner here
    reach = f"(100 + {percent}) * (n - pos) >= {percent} * n + {percent} * greatest(least, {percent} * n / 100)"
    live = entries.join(main, "token").filter(reach)
    a, b = live.alias("a"), live.alias("b")
    apart = "a.component != a.main and a.component != b.component and (b.component = b.main or a.doc_id < b.doc_id)"
    placed = "((a.n <= b.n and a.pos < a.index_length) or (b.n <= a.n and b.pos < b.index_length))"
    joined = a.join(b, (F.col("a.token") == F.col("b.token")) & F.expr(f"{apart} and {placed} and {_possible('a', 'b', percent)}"))
    return joined.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()


def _sharing(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share as many tokens as similarity asks.

    Of a similar pair's overlap at most ``n - overlap`` tokens are missing on a side, so of its prefix at least
    ``length - (n - overlap)`` are shared: ``matches`` for the least overlap that any partner needs, and more for this
    one.  The prefix that ends first in the global order lies within reach of the other.
    """
    side = lambda name: cut.select(F.col("doc_id").alias(name), F.struct("n", "tokens").alias(f"_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = f"ceil({percent} * (_a.n + _b.n) / {100 + percent}.0)"
    asked = f"least(size(_a.tokens) - _a.n, size(_b.tokens) - _b.n) + {overlap}"
    return both.filter(f"size(array_intersect(_a.tokens, _b.tokens)) >= {asked}").select("a", "b").distinct()


def link_classes(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row, linked at Jaccard >= ``percent`` / 100."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(source, k), "ngram_signatures")
    rows = signed.filter("chunk is null").select("doc_id", "n_shingles", "s1", "s2")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first"))
    firsts = classes.select(F.col("first").alias("doc_id")).distinct()

    cut = stored(prefixes(source, frequencies(signed), k, percent).join(firsts, "doc_id", "left_semi"), "ngram_prefixes")
    every = cut.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    shared = every.groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least != most").select("token")
    lengths = cut.select("doc_id", "n", "index_length")
    entries = stored(every.join(shared, "token").join(lengths, "doc_id"), "ngram_entries")

    links = None
    labels = None
    for find in (_star_pairs, _open_pairs):
        pairs = _sharing(find(_labelled(entries, labels), percent), cut, percent)
        found = stored(verified(pairs, source, k, percent), "ngram_links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    named = classes.join(labels, classes["first"] == labels["id"], "left").select(
        "n_shingles", "s1", "s2", F.coalesce("component", "first").alias("component_id")
    )
    linked = rows.join(named, ["n_shingles", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one_per_class(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``documents`` for each class of similar texts, that of the smallest id (null last, then by text hash).

    A row is what its id and text say: rows that share an id and differ in their texts are documents of their own, rows
    without an id take part, rows that repeat both are one document (of those the one with the least hash of all other
    columns stays).  Texts without words are similar to nothing, so only their repetitions go.
    """
    text = F.col("text").cast("string")
    key, text_hash = F.xxhash64("doc_id", text), F.xxhash64(F.lit(1), text)
    named = documents.select(key.alias("key"), text_hash.alias("text_hash"), F.col("doc_id").alias("id"))
    counted = named.groupBy("key", "text_hash", "id").agg(F.count("*").alias("n"))
    classes = link_classes(documents.select(key.alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("key"), "component_id").distinct()
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "key", "n")
    first = counted.join(classes, "key").groupBy("component_id").agg(F.min(rank).alias("first"))
    first = first.select(*[F.col(f"first.{c}").alias(f"_first_{c}") for c in ("key", "text_hash", "n")])
    joined = documents.join(first, (key == F.col("_first_key")) & (text_hash == F.col("_first_text_hash")))
    once = joined.filter("_first_n = 1").select(*documents.columns)
    others = [c for c in documents.columns if not isinstance(documents.schema[c].dataType, MapType)]
    again = joined.filter("_first_n > 1").groupBy("_first_key").agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*others)).alias("row"))
    return once.unionByName(again.select("row.*"))
