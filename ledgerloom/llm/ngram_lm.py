"""Language-model scoring with a weighted backoff automaton.

States are n-gram contexts (here up to one word).  A state has an arc for each word seen after it, weighted with the
smoothed log probability, and a failure arc to the shorter context, weighted with what the state leaves to unseen
words; the empty state has an arc for every word.  With c the training counts and M the strength of the prior,

    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | u) = (c(u w) + M P(w)) / (c(u) + M),

so a word without an arc costs the failure weight log10(M / (c(u) + M)) and then log10 P(w); a text is scored in one
pass from left to right.

The automaton of a whole corpus is never in one place.  Documents are read in blocks of bounded size; a block asks for
its distinct n-grams once, sorted by fingerprint, and brings their counts in its training documents along; requests
are dealt by fingerprint, summed, and answered in the order asked, so a block gets just the arcs that its texts can
walk.  Requests grow with the corpus and no answer is cut.

Defined cases: a null or empty text is its end token alone; ids that are null are hashed as the empty text; repeated
rows are trained on and scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tables import stored

#: Text bytes of a block, or one longer text.
BLOCK = 4 << 20
#: Fingerprints that one dealt part should hold.
PART_KEYS = 1_000_000
PRIOR = 20.0
FOLDS, HELD = 5, 1
#: The end token and the context before the first word.
END, BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
UNIGRAM, BIGRAM = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)


def held_out(ids: list) -> np.ndarray:
    """Whether each id's checksum falls into the held-out fold."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD for i in ids], bool)


class Block:
    """The tokens of some texts: ``words`` with an end token after each text, ``limits`` of the texts, and for each
    token the fingerprints of the word and of the arc it takes from its context."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = tokens.flat(texts)
        starts, _, prints = tokens.words(data, offsets)
        limits = tokens.word_limits(starts, offsets)
        n = len(limits) - 1
        self.limits = limits + np.arange(n + 1)
        words = np.empty(len(prints) + n, np.uint64)
        is_end = np.zeros(len(words), bool)
        is_end[self.limits[1:] - 1] = True
        words[is_end] = END
        words[~is_end] = prints
        context = np.empty_like(words)
        context[1:] = words[:-1]
        context[self.limits[:-1]] = BEGIN
        self.owner = np.repeat(np.arange(n), np.diff(self.limits))
        self.word = tokens.mixed(words ^ UNIGRAM)
        self.arc = tokens.mixed(words * np.uint64(3) + tokens.mixed(context ^ BIGRAM))


def _requests(block: Block, trained: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct fingerprints, their counts in training texts, which are single words, and for each token the
    places of its word and of its arc among them."""
    inside = trained[block.owner]
    begin = tokens.mixed(np.array([BEGIN ^ UNIGRAM]))
    keys, place = np.unique(np.concatenate([block.word, block.arc, begin]), return_inverse=True)
    place = place.astype(np.int32)
    n = len(block.word)
    counts = np.bincount(place[: 2 * n], np.tile(inside, 2), len(keys)).astype(np.int64)
    counts[place[-1]] += int(trained.sum())  # each training text enters the begin state once
    single = np.zeros(len(keys), bool)
    single[place[:n]] = True
    return keys, counts, single, place[:n], place[n : 2 * n]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to blocks."""
    held, size = [], 0
    for batch in batches:
        for part in tokens.text_batches([batch], BLOCK):
            b = part.nbytes
            if held and size + b > BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += b
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


REQUEST = "part int, block string, first int, width int, keys binary, counts array<bigint>, singles array<boolean>, ids array<bigint>, sizes array<int>, texts binary"


def packed(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted fingerprints as differences of 6 bytes each, or 8 where one is larger."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = 6 if len(steps) < 2 or int(steps[1:].max()) < 1 << 48 else 8
    head = steps[:1].view(np.uint8).tobytes()
    return width, head + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(width: int, raw: bytes) -> np.ndarray:
    steps = np.zeros((1 + (len(raw) - 8) // width, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8)
    steps[1:, :width] = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _block_name(texts: pa.RecordBatch, partition: int, ordinal: int) -> str:
    """A block's name by its place and by all that it holds."""
    data, offsets = tokens.flat(texts.column("text"))
    held = hashlib.blake2b(f"{partition}:{ordinal}:{texts.column('doc_id').to_pylist()}".encode(), digest_size=16)
    held.update(offsets.tobytes())
    held.update(data)
    return held.hexdigest()


def _ask(documents: DataFrame, parts: int) -> DataFrame:
    """Requests (a row per block and part that it asks) and, with part null, the blocks' documents."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    names = [c.split(" ")[0] for c in REQUEST.split(", ")]

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        with np.errstate(over="ignore"):
            for texts in _blocks(batches):
                block = Block(texts.column("text"))
                trained = ~held_out(texts.column("doc_id").to_pylist())
                keys, counts, single, _, _ = _requests(block, trained)
                # the same block has the same name however often its task runs
                name = _block_name(texts, TaskContext.get().partitionId(), ordinal)
                ordinal += 1
                ends = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
                some = np.flatnonzero(np.diff(ends))
                ends = np.concatenate([ends[some], [len(keys)]])
                n = len(some)
                width, raw = zip(*(packed(keys[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)), strict=True)
                yield pa.record_batch(
                    [
                        pa.array(some.astype(np.int32)), pa.array([name] * n), pa.array(ends[:-1].astype(np.int32)),
                        pa.array(width, pa.int32()), pa.array(raw, pa.binary()), lists(counts, ends), lists(single, ends),
                        pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
                data, offsets = tokens.flat(texts.column("text"))
                one = np.array([0, texts.num_rows])
                ids = pa.ListArray.from_arrays(pa.array(one, pa.int32()), texts.column("doc_id").cast(pa.int64()))
                sizes = lists(np.diff(offsets).astype(np.int32), one)
                held = pa.array([pa.Codec("zstd", compression_level=3).compress(data.tobytes(), asbytes=True)], pa.binary())
                empty = [pa.nulls(1, x) for x in (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))]
                yield pa.record_batch([pa.nulls(1, pa.int32()), pa.array([name]), *empty, ids, sizes, held], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(ask, REQUEST)


ANSWER = "block string, first int, totals array<bigint>, n_known bigint, n_tokens bigint, ids array<bigint>, sizes array<int>, texts binary"


def _answer(asked: DataFrame, parts: int) -> DataFrame:
    """Sums the counts of each part and sends every block the totals of its keys, in its order; the blocks' documents
    pass through.  The known words and their tokens are counted in one row per part (block null)."""
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            requests = batch.filter(batch.column("part").is_valid())
            documents = batch.filter(batch.column("part").is_null())
            if documents.num_rows:
                n = documents.num_rows
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())]
                yield pa.record_batch([documents.column("block"), *empty, *(documents.column(c) for c in ("ids", "sizes", "texts"))], names=names)
            for i in range(requests.num_rows):
                keys = unpacked(requests.column("width")[i].as_py(), requests.column("keys")[i].as_py())
                values = [keys, *(requests.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("counts", "singles"))]
                by_part.setdefault(requests.column("part")[i].as_py(), []).append(
                    (requests.column("block")[i].as_py(), requests.column("first")[i].as_py(), *values)
                )
        begin = tokens.mixed(np.array([BEGIN ^ UNIGRAM]))[0]
        for rows in by_part.values():
            keys = np.concatenate([r[2] for r in rows])
            every, place = np.unique(keys, return_inverse=True)
            totals = np.bincount(place, np.concatenate([r[3] for r in rows]), len(every)).astype(np.int64)
            single = np.zeros(len(every), bool)
            single[place[np.concatenate([r[4] for r in rows])]] = True
            single &= (totals > 0) & (every != begin)
            ends = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            n = len(rows)
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows] + [None], pa.string()), pa.array([r[1] for r in rows] + [None], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]).astype(np.int32)), pa.array(totals[place])),
                    pa.array([None] * n + [int(single.sum())], pa.int64()), pa.array([None] * n + [int(totals[single].sum())], pa.int64()),
                    pa.nulls(n + 1, pa.list_(pa.int64())), pa.nulls(n + 1, pa.list_(pa.int32())), pa.nulls(n + 1, pa.binary()),
                ],
                names=names,
            )

    # documents have no part: they are spread by their block
    dealt = asked.repartition(parts, F.coalesce("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")))
    return dealt.mapInArrow(answer, ANSWER)


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def walk(block: Block, trained: np.ndarray, totals: np.ndarray, known: int, n_tokens: int, prior: float) -> tuple[np.ndarray, ...]:
    """Scores every text of a block by its automaton: per token the arc of the state it is in or, failing that, the
    failure arc and the word's arc at the empty state."""
    keys, _, _, word, arc = _requests(block, trained)
    # the state after a word is that word's, and each text begins in the begin state
    begin = np.searchsorted(keys, tokens.mixed(np.array([BEGIN ^ UNIGRAM])))[0]
    state = np.empty_like(word)
    state[1:] = word[:-1]
    state[block.limits[:-1]] = begin
    c_word, c_arc, c_state = totals[word], totals[arc], totals[state]
    root = np.log10((c_word + 0.5) / (n_tokens + 0.5 * (known + 1)))
    failure = np.log10(prior / (c_state + prior))
    seen = np.log10((c_arc + prior * 10.0**root) / (c_state + prior))
    step = np.where(c_arc > 0, seen, failure + root)
    n = len(block.limits) - 1
    sums = lambda x: np.bincount(block.owner, x, n)
    return np.diff(block.limits), sums(c_word > 0).astype(np.int64), sums(root), sums(step)


def score(documents: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document."""
    size = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(4, int(size // (PART_KEYS * 4)))  # about four bytes of text bring one fingerprint
    answered = stored(_answer(_ask(documents, parts), parts), "lm_answers")
    known, n_tokens = answered.filter("block is null").agg(F.coalesce(F.sum("n_known"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, its documents first and then its totals in the order asked."""

        def finish(held: tuple, totals: list[np.ndarray]) -> pa.RecordBatch:
            ids, sizes, raw = held
            data = pa.decompress(raw, decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))
            out = held_out(ids.to_pylist())
            n, n_known, base, full = walk(Block(texts), ~out, np.concatenate(totals), known, n_tokens, prior)
            return pa.record_batch(
                [ids, pa.array(out), pa.array(n), pa.array(n_known), pa.array(base), pa.array(full)],
                names=[c.split(" ")[0] for c in RESULT.split(", ")],
            )

        with np.errstate(over="ignore"):
            block, held, totals = None, None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    name = batch.column("block")[i].as_py()
                    if name != block:
                        if held is not None:
                            yield finish(held, totals)
                        block, held, totals = name, None, []
                    if batch.column("totals")[i].is_valid:
                        totals.append(batch.column("totals")[i].values.to_numpy())
                    else:
                        held = batch.column("ids")[i].values, batch.column("sizes")[i].values.to_numpy(), batch.column("texts")[i].as_py()
            if held is not None:
                yield finish(held, totals)

    rows = answered.filter("block is not null").select("block", "first", "totals", "ids", "sizes", "texts")
    gathered = rows.repartition("block").sortWithinPartitions("block", F.col("first").asc_nulls_first())
    scored = gathered.mapInArrow(walks, RESULT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
