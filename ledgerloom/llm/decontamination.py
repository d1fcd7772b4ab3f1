"""Benchmark decontamination with DataFrame functions only.

Every window of 13 consecutive benchmark words (an item of fewer words is one shorter window) is normalised and
hashed once.  One scan of the documents hashes their windows of the same lengths and probes that set; hash hits are
verified word by word before they count.

Defined cases: a null or empty text has no words and no hits; rows that repeat (same id, same text) each get the same
result; null ids are kept as ids; an item whose id is null marks words as hit but is not listed; an empty benchmark
hits nothing; columns of ``documents`` other than id and text are never read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, text_or_empty

WINDOW = 13
#: Words are runs of ASCII digits, a-z and everything beyond ASCII, after A-Z has been lower-cased: one translation
#: does both, and words are then what spaces separate (a plain class that Java matches by table).
CAPITALS = "".join(map(chr, range(0x41, 0x5B)))
BREAKS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WORD = "[^ ]+"
#: The window set, and failing that the set of its hashes, is broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20
#: A document is contaminated when SHARE * n_hit >= n_words.
SHARE = 20
#: Stands for "every document" among the window hashes.
MARKER = 0


def normal_text(text: Column) -> Column:
    return F.translate(text, CAPITALS + BREAKS, CAPITALS.lower() + " " * len(BREAKS))


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(normal_text(text), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``gram_hash, length, gram`` (words) and ``items``, the ids that hold it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal_words(text_or_empty()).alias("words"))
    sized = words.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("length")).filter("length > 0")
    grams = sized.select(
        "item_id", "length", F.explode(F.expr("transform(sequence(1, size(words) - length + 1), i -> slice(words, i, length))")).alias("gram")
    )
    return (
        grams.groupBy("length", "gram")
        .agg(F.collect_set("item_id").alias("items"))
        .select(F.expr("xxhash64(transform(gram, w -> xxhash64(w)))").alias("gram_hash"), "length", "gram", "items")
    )


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, text_hash, n_words, start, length, items``: each verified occurrence of a benchmark window, and one
    marker row of length 0 for every document, so that a single scan also counts the words.

    Windows of up to ``broadcast_bytes`` are broadcast whole, with the marker among them.  Of larger benchmarks only the
    hashes are, by the same bound; beyond that, hashes meet in a shuffle that carries no words (``_scan_many``).
    """
    grams = benchmark_windows(benchmark, window)
    size = grams.agg(F.sum(F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items")) + 64)).first()[0] or 0
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most `window` values
    words = documents.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), normal_words(text_or_empty()).alias("words"))
    if size > broadcast_bytes:
        return _scan_many(words, stored(grams, "benchmark_windows"), lengths, broadcast_bytes)
    marker = grams.sparkSession.range(1).select(
        F.lit(MARKER).cast("long").alias("gram_hash"),
        F.lit(0).alias("length"),
        F.expr("cast(array() as array<string>)").alias("gram"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    grams = F.broadcast(grams.unionByName(marker))
    hashed = words.select("doc_id", "text_hash", "words", F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    runs = _window_hashes(lengths)
    windows = hashed.select("doc_id", "text_hash", "words", F.expr(f"concat(array({MARKER}L){''.join(', ' + r for r in runs)})").alias("grams"))
    rows = windows.select("doc_id", "text_hash", "words", F.posexplode_outer("grams").alias("at", "gram_hash"))
    before = "1"  # the marker and the windows of the lengths listed earlier come first in `grams`
    start = "case length when 0 then 0"
    for n in lengths:
        start += f" when {n} then at - ({before})"
        before += f" + greatest(size(words) - {n} + 1, 0)"
    hits = rows.join(grams, "gram_hash").withColumn("start", F.expr(start + " end"))
    held = hits.filter("slice(words, cast(start as int) + 1, length) = gram")
    return held.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "start", "length", "items")


def _window_hashes(lengths: list[int]) -> list[str]:
    """SQL for the hashes of all windows of each length."""
    return [f"if(size(hashes) >= {n}, transform(sequence(1, size(hashes) - {n} + 1), i -> xxhash64(slice(hashes, i, {n}))), array())" for n in lengths]


def _scan_many(words: DataFrame, grams: DataFrame, lengths: list[int], broadcast_bytes: int) -> DataFrame:
    """``scan`` for benchmarks whose windows are too many to broadcast.

    Windows go out as (row, place, hash); only those whose hash the benchmark has come back to words to be verified.  A
    passage that many documents hold is one row of the small table of windows hit, not a key of all its sightings.
    """
    keys = ["doc_id", "text_hash"]
    marks = words.select(*keys, F.size("words").cast("long").alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.expr("cast(array() as array<string>)").alias("items"))
    hashed = words.select(*keys, "words", F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    every = F.expr(f"concat({', '.join(_window_hashes(lengths))})").alias("grams")
    rows = hashed.select(*keys, "words", F.size("words").alias("size"), every).select(*keys, "words", "size", F.posexplode("grams").alias("at", "gram_hash"))
    start, length, before = "case", "case", "0"
    for n in lengths:
        until = f"{before} + greatest(size - {n} + 1, 0)"
        start, length, before = f"{start} when at < {until} then at - ({before})", f"{length} when at < {until} then {n}", until
    place = [F.expr(start + " end").cast("int").alias("start"), F.expr(length + " end").alias("length")]
    hashes = grams.select("gram_hash").distinct()
    cut = F.expr("slice(words, start + 1, length)").alias("gram")
    if hashes.count() * 16 <= broadcast_bytes:
        near = rows.join(F.broadcast(hashes), "gram_hash", "left_semi").select(*keys, "words", "gram_hash", *place)
        near = stored(near.select(*keys, "gram_hash", "start", "length", cut), "benchmark_hits")
    else:
        near = stored(rows.select(*keys, "gram_hash", *place).join(hashes, "gram_hash", "left_semi"), "benchmark_places")
        held = near.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        of = words.join(held, words["doc_id"].eqNullSafe(held["_id"]) & (words["text_hash"] == held["_hash"]), "left_semi").dropDuplicates(keys)
        of = of.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "words")
        near = near.join(of, near["doc_id"].eqNullSafe(of["_id"]) & (near["text_hash"] == of["_hash"])).select(*keys, "gram_hash", "start", "length", cut)
    seen = near.select("gram_hash").distinct()
    hit = stored(grams.join(seen, "gram_hash", "left_semi"), "benchmark_windows_hit")
    size = hit.agg(F.sum(F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items")) + 64)).first()[0] or 0
    held = near.join(F.broadcast(hit) if size <= broadcast_bytes else hit, ["gram_hash", "length", "gram"])
    return marks.unionByName(held.select(*keys, F.lit(None).cast("long").alias("n_words"), "start", "length", "items"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, items`` (sorted ids), ``hit`` (positions of the hit
    words), ``contaminated``."""
    merged = scan(documents, benchmark, window, broadcast_bytes).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum((F.col("length") == 0).cast("long")).alias("n_rows"),
        F.collect_set(F.when(F.col("length") > 0, F.struct("start", "length"))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = "array_sort(array_distinct(flatten(transform(windows, w -> sequence(w.start, w.start + w.length - 1)))))"
    found = merged.select("doc_id", "text_hash", "n_words", "n_rows", "items", F.expr(covered).alias("hit"))
    judged = found.select("doc_id", "text_hash", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "hit", "n_rows")
    judged = judged.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))
    return judged.withColumn("copy", F.explode(F.expr("sequence(1L, n_rows)"))).drop("copy", "n_rows")


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns."""
    judged = contamination(documents.select("doc_id", "text"), benchmark, window)
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = documents["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == bad["_bad_hash"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text``: contaminated documents with their hit words (and the separators after them) cut out."""
    judged = contamination(documents.select("doc_id", "text"), benchmark, window).filter("contaminated")
    bad = judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "hit").distinct()
    source = documents.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("_text_hash"))
    joined = source.join(bad, source["doc_id"].eqNullSafe(bad["_id"]) & (source["_text_hash"] == bad["_hash"]), "left")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all("text", F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{gap}"), F.lit(0))
    head = F.regexp_extract("text", rf"^{gap}", 0)
    # what stands between one hit and the next, so that a piece is copied once however many hits there are
    after, until = "if(j = 0, 0, hit[j - 1] + 1)", "if(j = size(hit), size(pieces), hit[j])"
    kept = F.expr(f"flatten(transform(sequence(0, size(hit)), j -> slice(pieces, {after} + 1, {until} - {after})))")
    cut = joined.select("doc_id", "text", F.expr("transform(hit, h -> cast(h as int))").alias("hit"), pieces.alias("pieces"), head.alias("head"))
    return cut.select("doc_id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.concat("head", F.concat_ws("", kept))).alias("text"))
