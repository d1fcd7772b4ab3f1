"""Alignment of two tokenizers' cuts of the same text, by merge-path partitioning.

Both tokenizers cut one byte string: A encodes space + text, B the text (its model adds the space).  Their token ends
are two sorted lists, and merging them gives everything: each merged end closes one link (the A and the B token that
overlap before it), and an end that both lists have closes a group.  The merge is divided by merge-path: a binary search
on every ``PIECE``-th diagonal finds how many A and B tokens lie before it, so all pieces hold the same number of
tokens however long a document is or how differently the two cut it.  A piece is a table row of its own (its tokens,
one token ahead on each side, where the first ones begin), is merged without the others, in any task, and emits the
overlaps that end in it; groups that cross a cut are stitched from the boundary pieces.

Counts of linked id pairs cover the whole corpus: summed in the tasks first, then by key.  The most frequent pairs, at
most ``HEAD`` of them, are broadcast; the others, none of which can be hot, are joined by key.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space + text (a character that a
tokenizer rewrites), have no tokens: one piece without tokens, counts 0, no groups, digest ''.  Rows that repeat an id
or a text stay rows of their own; a null id is carried along.  A long text is encoded in parts cut before single spaces,
which no token of either vocabulary crosses; a run without any is encoded whole.  An empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .tables import stored

#: Where the vocabulary files lie on the driver; executors get their bytes from it.
FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of both sides in a piece.
PIECE = 1 << 14
#: Characters of a text encoded at once, and bytes of the texts of a step.
PART = 1 << 16
STEP_BYTES = 2 << 20
#: Pairs whose counts are broadcast, at most: 17 bytes each.
HEAD = 1 << 20
#: Links held in a task before their pairs are summed.
HELD = 1 << 21

PIECES = (
    "_row bigint, {id}, piece int, own_a int, own_b int, groups int, a_at int, b_at int, a_ids binary, b_ids binary, groups_sha256 string"
)


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: how a byte-level vocabulary cuts a text before it merges bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Index(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


@dataclass
class Tokenizers:
    """Both vocabularies as bytes, so that they travel to the executors; the libraries' objects are made there.

    A plain byte-level file whose merges stand in the order of their ids is encoded by ranks, which gives the same ids in
    a fraction of the time; any other by the library that the file is made for.
    """

    file_a: bytes
    file_b: bytes

    def __getstate__(self):
        return self.file_a, self.file_b

    def __setstate__(self, state):
        self.file_a, self.file_b = state

    @cached_property
    def _vocabulary(self) -> tuple[dict[str, int], dict[str, int], bool]:
        """Entries, added entries, and whether ranks give the same ids."""
        file = json.loads(self.file_a)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        merges = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        by_rank = (
            file["normalizer"] is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(model["vocab"].get(entry) == 256 + i for i, entry in enumerate(merges))
        )
        return model["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}, by_rank

    @cached_property
    def encode_a(self):
        """A function from a text to its ids."""
        entries, added, by_rank = self._vocabulary
        if by_rank:
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in e): i for e, i in entries.items() if e not in added}
            made = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda text: made.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.file_a.decode())
        library.encode_special_tokens = True
        library.no_truncation()
        library.no_padding()
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.int64)

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.file_b)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        letters, (entries, added, _) = _byte_letters(), self._vocabulary
        out = [b""] * (max([*entries.values(), *added.values()]) + 1)
        for entry, i in entries.items():
            if entry not in added:
                out[i] = bytes(letters[c] for c in entry)
        for entry, i in added.items():
            out[i] = entry.encode()
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        piece = self.b.id_to_piece
        every = range(self.b.get_piece_size())
        return [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in every]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))

    @cached_property
    def joined(self) -> tuple[pa.Array, pa.Array]:
        """Each side's entries as an array, so that the bytes of many tokens are joined at once."""
        return pa.array(self.bytes_a, pa.large_binary()), pa.array(self.bytes_b, pa.large_binary())

    @cached_property
    def decimals(self) -> tuple[pa.Array, int]:
        """``id,`` and ``id|`` of A, then ``id,`` and ``id;`` of B; and how many ids A has."""
        n, m = len(self.bytes_a), len(self.bytes_b)
        marks = [f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)]
        return pa.array(marks + [f"{i},".encode() for i in range(m)] + [f"{i};".encode() for i in range(m)], pa.large_binary()), n

    def encode(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts in a row and the limits of each; none where the joined bytes differ.

        Words behind single spaces are encoded the same wherever they stand, so each distinct one is encoded once.
        """
        index = _Index()
        codes, limits = [], [0]
        for text in texts:
            if text:
                codes += map(index.__getitem__, SINGLE_SPACE.split(text))
            limits.append(len(codes))
        words, codes, limits = list(index), np.array(codes, np.int64), np.array(limits)
        sides = [self._runs_of(words, side) for side in range(2)]
        wrong = np.append(0, np.cumsum(~(sides[0][2] & sides[1][2])[codes]))
        spelled = np.repeat(wrong[limits[1:]] == wrong[limits[:-1]], np.diff(limits))
        of, codes = np.repeat(np.arange(len(texts)), np.diff(limits))[spelled], codes[spelled]
        out = []
        for ids, starts, _ in sides:
            sizes = np.diff(starts)[codes]
            before = np.append(0, np.cumsum(sizes))
            take = np.repeat(starts[codes] - before[:-1], sizes) + np.arange(before[-1])
            out.append((ids[take], before[np.searchsorted(of, np.arange(len(texts) + 1))]))
        return out[0], out[1]

    def _runs_of(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One side's ids of all words in a row, the limits of each, and whether its tokens spell it.

        Words are encoded in one text, which is cut where its bytes say; those beyond ASCII, which a tokenizer may rewrite,
        apart from the others, and one by one if any of them is rewritten.  The ends of a text may be white space, beside
        which a space is no cut: they are encoded alone.
        """
        kind = 1 - np.fromiter(map(str.isascii, words), bool, len(words)).astype(np.int64)
        kind[[i for i, w in enumerate(words) if not w or w[0].isspace() or w[-1].isspace()]] = 2
        sizes, good, parts = np.zeros(len(words), np.int64), np.zeros(len(words), bool), []
        order = np.argsort(kind, kind="stable")
        for k in range(3):
            group = np.flatnonzero(kind == k)
            own = [words[i] for i in group.tolist()]
            joined = " ".join(own)
            ids = self._ids(joined, side) if own and k < 2 else np.zeros(0, np.int64)
            if len(ids) and _spells(ids, self.joined[side], " " + joined):
                ends = np.cumsum(pc.binary_length(pa.array(own)).to_numpy().astype(np.int64) + 1)
                stops = np.searchsorted(np.cumsum(self.lengths[side][ids]), ends) + 1
                sizes[group], good[group] = np.diff(stops, prepend=0), True
                parts.append(ids)
            elif own:
                runs = [self._ids(w, side) for w in own]
                sizes[group], good[group] = [len(r) for r in runs], [_spells(r, self.joined[side], " " + w) for r, w in zip(runs, own, strict=True)]
                parts += runs
        # the runs lie in the order of the groups; limits by word
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at = np.append(0, np.cumsum(sizes[order]))[:-1]
        starts = np.zeros(len(words), np.int64)
        starts[order] = at
        return _in_order(ids, starts, sizes) + (good,)

    def _ids(self, text: str, side: int) -> np.ndarray:
        parts = split_parts(text)
        found = [self.encode_a(" " + p) if side == 0 else np.array(self.b.encode(p), np.int64) for p in parts]
        return np.concatenate(found)


def _in_order(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs one behind the other, and their limits."""
    limits = np.append(0, np.cumsum(sizes))
    return ids[np.repeat(starts - limits[:-1], sizes) + np.arange(limits[-1])], limits


def _spells(ids: np.ndarray, entries: pa.Array, text: str) -> bool:
    """Do the tokens' bytes, joined, make the text?"""
    raw = entries.take(pa.array(ids)).buffers()[2] if len(ids) else None
    return (b"" if raw is None else raw.to_pybytes()) == text.encode()


#: No token of either vocabulary goes on behind a single space between two characters that are none.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def split_parts(text: str, size: int | None = None) -> list[str]:
    """The text cut at single spaces, which are left out, into parts of about ``size`` characters."""
    size = PART if size is None else size
    parts, start = [], 0
    while len(text) - start > size and (cut := SINGLE_SPACE.search(text, start + size)):
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def load(folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> Tokenizers:
    """The two tokenizers: files whose size does not grow with the data, so they and what they say may be broadcast."""
    return Tokenizers(Path(folder, file_a).read_bytes(), Path(folder, file_b).read_bytes())


def _lengths(spark: SparkSession, folder: str):
    """Bytes of every token of both sides, as a broadcast value: all that the steps after the encoding know of them."""
    return spark.sparkContext.broadcast(load(folder).lengths)


def merge_cuts(ends_a: np.ndarray, ends_b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B ends are among the first ``diagonal`` of the merged list, A first where they tie; a cut between
    two equal ends moves behind both.  All diagonals are searched at once."""
    low, high = np.maximum(0, diagonals - len(ends_b)), np.minimum(diagonals, len(ends_a))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        before = ends_a[middle] <= ends_b[diagonals[open_] - 1 - middle]
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    i, j = low, diagonals - low
    inner = (i > 0) & (j < len(ends_b))
    split = np.zeros(len(i), bool)
    split[inner] = ends_a[i[inner] - 1] == ends_b[j[inner]]
    return i, j + split


_CODEC = pa.Codec("zstd", compression_level=1)


def _packed(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Runs of ids as compressed 32-bit numbers behind their count: a batch of many documents stays small in the JVM."""
    ids = ids.astype("<u4")
    runs = (ids[x:y].tobytes() for x, y in zip(starts.tolist(), stops.tolist(), strict=True))
    return pa.array([len(r).to_bytes(8, "little") + _CODEC.compress(r, asbytes=True) if r else b"" for r in runs], pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of runs, and the limits of each run."""
    runs = [r and _CODEC.decompress(r[8:], int.from_bytes(r[:8], "little"), asbytes=True) for r in column.to_pylist()]
    return np.frombuffer(b"".join(runs), "<u4").astype(np.int64), np.append(0, np.cumsum([len(r) // 4 for r in runs], dtype=np.int64))


def _shared(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end where the other side ends too."""
    at = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
    shared_a = ends_b[at] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
    shared_b = np.zeros(len(ends_b), bool)
    shared_b[at[shared_a]] = True
    return shared_a, shared_b


def _digests(know: Tokenizers, ids_a, at_a, last_a, ids_b, at_b, last_b) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2`` per text: every token takes its place behind the groups before it."""
    marks, n = know.decimals
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(ids_a)) + np.append(0, np.flatnonzero(last_b) + 1)[group_a]
    place_b = np.arange(len(ids_b)) + (np.flatnonzero(last_a) + 1)[group_b]
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    order[place_a] = ids_a + n * last_a
    order[place_b] = 2 * n + ids_b + len(know.bytes_b) * last_b
    joined = marks.take(pa.array(order))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)
    raw = memoryview(joined.buffers()[2]) if len(order) else memoryview(b"")
    limits = offsets[at_a + at_b] if len(order) else np.zeros(len(at_a), np.int64)
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in pairwise(limits.tolist())]


def pieces(documents: DataFrame, folder: str = FOLDER, size: int = PIECE) -> DataFrame:
    """The merge of every document's tokens in pieces of ``size`` tokens, one row each:

    ``_row`` (a number for the document's row), ``doc_id, piece, own_a, own_b`` (tokens that end here), ``groups`` (groups
    that end here), ``a_ids, b_ids`` (own tokens and the next one, packed), ``a_at, b_at`` (bytes by which the first begins later
    than the other side's), and ``groups_sha256`` of the whole document on its piece 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(folder))
    schema = PIECES.format(id=f"doc_id {documents.schema['doc_id'].dataType.simpleString()}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = shared.value
        for batch in tokens.text_batches(batches, STEP_BYTES):
            (ids_a, at_a), (ids_b, at_b) = know.encode(batch.column("text").to_pylist())
            # texts follow one another on one line of bytes; each ends where both sides end
            ends_a, ends_b = np.cumsum(know.lengths[0][ids_a]), np.cumsum(know.lengths[1][ids_b])
            shared_a, shared_b = _shared(ends_a, ends_b)
            first = at_a + at_b
            doc = np.repeat(np.arange(batch.num_rows), np.maximum(1, -(-np.diff(first) // size)))
            piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
            i, j = merge_cuts(ends_a, ends_b, np.append(first[doc] + piece * size, first[-1]))
            i, j = np.where(np.append(piece, 0) == 0, at_a[np.append(doc, batch.num_rows)], i), np.where(np.append(piece, 0) == 0, at_b[np.append(doc, batch.num_rows)], j)
            ahead_a, ahead_b = np.minimum(i[1:] + 1, at_a[doc + 1]), np.minimum(j[1:] + 1, at_b[doc + 1])
            start_a, start_b = np.append(0, ends_a)[i[:-1]], np.append(0, ends_b)[j[:-1]]
            origin = np.minimum(start_a, start_b)
            closed = np.append(0, np.cumsum(shared_a))[i]  # groups that end before each cut: no cut parts two equal ends
            digests = _digests(know, ids_a, at_a, shared_a, ids_b, at_b, shared_b)

            numbers = [piece, np.diff(i), np.diff(j), np.diff(closed), start_a - origin, start_b - origin]
            piece_, own_a, own_b, groups_, a_at, b_at = (pa.array(x, pa.int32()) for x in numbers)
            named = pa.array([digests[d] if p == 0 else None for d, p in zip(doc.tolist(), piece.tolist(), strict=True)], pa.string())
            source = pa.array(doc)
            yield pa.record_batch(
                [batch.column("_row").take(source), batch.column("doc_id").take(source), piece_, own_a, own_b, groups_, a_at, b_at]
                + [_packed(ids_a, i[:-1], ahead_a), _packed(ids_b, j[:-1], ahead_b), named],
                names=["_row", "doc_id", "piece", "own_a", "own_b", "groups", "a_at", "b_at", "a_ids", "b_ids", "groups_sha256"],
            )

    source = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, schema)


@dataclass
class Merged:
    """The merges of a batch of pieces: ids, ends, own tokens and limits of both sides, and where each piece begins."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    starts_a: np.ndarray
    own_a: np.ndarray
    own_b: np.ndarray
    limits_a: np.ndarray
    limits_b: np.ndarray
    base: np.ndarray

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """``row, code`` of all overlaps that end in the pieces, a code being ``A id * 2^32 + B id``.

        An A token overlaps the B tokens from the first that ends behind its start to the first that does not end
        before its end; the overlap belongs to the piece that owns the token that ends first.
        """
        row = np.repeat(np.arange(len(self.base)), np.diff(self.limits_a))
        if not len(row):
            return row, row
        stop = np.searchsorted(self.ends_b, self.ends_a)
        start = np.append(0, stop[:-1] + (self.ends_b[np.minimum(stop[:-1], len(self.ends_b) - 1)] == self.ends_a[:-1]))
        new = self.limits_a[:-1][np.diff(self.limits_a) > 0]
        start[new] = np.searchsorted(self.ends_b, self.starts_a[new], "right")
        start = np.maximum(start, self.limits_b[row])
        sizes = np.maximum(np.minimum(stop, self.limits_b[row + 1] - 1) - start + 1, 0)
        a = np.repeat(np.arange(len(row)), sizes)
        b = np.repeat(start - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        end_a, end_b = self.ends_a[a], self.ends_b[b]
        owned = ((end_a <= end_b) & self.own_a[a]) | ((end_b <= end_a) & self.own_b[b])
        if not owned.all():
            a, b = a[owned], b[owned]
        return row[a], (self.ids_a[a] << 32) | self.ids_b[b]


def _merged(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> Merged:
    """All pieces of a batch on one line of bytes, each behind the ones before it."""

    def side(name: str, length: np.ndarray):
        ids, limits = _unpacked(batch.column(f"{name}_ids"))
        at = batch.column(f"{name}_at").to_numpy().astype(np.int64)
        sums = np.append(0, np.cumsum(length[ids]))
        row = np.repeat(np.arange(batch.num_rows), np.diff(limits))
        own = np.arange(len(ids)) - limits[row] < batch.column(f"own_{name}").to_numpy()[row]
        shift = at - sums[limits[:-1]]
        return ids, limits, row, own, sums, shift, sums[limits[1:]] + shift

    ids_a, limits_a, row_a, own_a, sums_a, shift_a, reach_a = side("a", lengths[0])
    ids_b, limits_b, row_b, own_b, sums_b, shift_b, reach_b = side("b", lengths[1])
    base = np.append(0, np.cumsum(np.maximum(reach_a, reach_b) + 1)[:-1])
    move_a, move_b = (shift_a + base)[row_a], (shift_b + base)[row_b]
    return Merged(ids_a, ids_b, sums_a[1:] + move_a, sums_b[1:] + move_b, sums_a[:-1] + move_a, own_a, own_b, limits_a, limits_b, base)


def _small(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut so that they hold about ``limit`` tokens, or one piece."""
    for batch in batches:
        sizes = batch.column("own_a").to_numpy() + batch.column("own_b").to_numpy()
        held = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(held, held[at] - sizes[at] + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def pair_counts(cut: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``code, n, best``: how many links of all documents hold an A and a B id together, and whether no other A id is
    linked with that B id more often.  Both ids come back with ``code_ids``."""
    shared = _lengths(cut.sparkSession, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, held, sums = shared.value, 0, []

        def summed():
            codes, at = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([x for _, x in sums])).astype(np.int64)

        for batch in _small(batches):
            codes, n = np.unique(_merged(batch, lengths).links[1], return_counts=True)
            sums.append((codes, n))
            held += len(codes)
            if held > HELD:
                sums = [summed()]
                held = len(sums[0][0])
                if held > HELD // 2:
                    yield pa.record_batch([pa.array(x) for x in sums.pop()], names=["code", "n"])
                    held = 0
        if sums:
            yield pa.record_batch([pa.array(x) for x in summed()], names=["code", "n"])

    parts = cut.select("own_a", "own_b", "a_at", "b_at", "a_ids", "b_ids").mapInArrow(count, "code bigint, n bigint")
    counts = stored(parts.groupBy("code").agg(F.sum("n").alias("n")), "pair_counts")
    most = counts.groupBy(_b_id().alias("b")).agg(F.max("n").alias("most"))  # a row per id of B's vocabulary at most
    return counts.join(F.broadcast(most), _b_id() == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _b_id() -> Column:
    return F.col("code").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def code_ids() -> list[Column]:
    return [F.shiftright("code", 32).cast("int").alias("a_id"), _b_id().cast("int").alias("b_id")]


def _head(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, ``limit`` at most, and the others: cut at the power of two that the limit allows."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = 1 << 62, 0  # one row per power of two was collected
    for power, count in sizes:
        if held + count > limit:
            return counts.filter(F.col("n") >= least), counts.filter(F.col("n") < least)
        held, least = held + count, 1 << power
    return counts, None


def link_totals(cut: DataFrame, counts: DataFrame, folder: str = FOLDER, head: int = HEAD) -> DataFrame:
    """``_row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document row."""
    counts = stored(counts, "pair_ranks")
    frequent, others = _head(counts, head)
    table = frequent.toArrow().sort_by("code")  # ``head`` rows at most
    spark = cut.sparkSession
    known = spark.sparkContext.broadcast((table["code"].to_numpy(), table["n"].to_numpy(), np.asarray(table["best"].to_numpy(zero_copy_only=False), bool)))
    shared = _lengths(spark, folder)
    schema = "_row bigint, n_links bigint, n_best bigint, count_sum bigint, codes array<bigint>, times array<bigint>"

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts_, best = known.value
        for batch in _small(batches):
            merged = _merged(batch, shared.value)
            (rows, own), n = merged.links, batch.num_rows
            at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
            found = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            sums = np.zeros(n, np.int64)
            np.add.at(sums, rows[found], counts_[at[found]])
            links, good = np.bincount(rows, minlength=n), np.bincount(rows[found], best[at[found]], n) if len(codes) else np.zeros(n)
            rest = ~found
            order = np.lexsort((own[rest], rows[rest]))
            r, c = rows[rest][order], own[rest][order]
            new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))[: len(r)]
            first = np.flatnonzero(new)
            limits = pa.array(np.searchsorted(r[first], np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int64))) for x in (c[first], np.diff(np.append(first, len(r))))]
            numbers = [pa.array(x.astype(np.int64)) for x in (links, good, sums)]
            yield pa.record_batch([batch.column("_row"), *numbers, *lists], names=["_row", "n_links", "n_best", "count_sum", "codes", "times"])

    scored = cut.select("_row", "own_a", "own_b", "a_at", "b_at", "a_ids", "b_ids").mapInArrow(total, schema)
    sums = scored.select("_row", "n_links", "n_best", "count_sum")
    if others is not None:
        scored = stored(scored, "link_totals")
        rare = scored.select("_row", F.inline(F.arrays_zip("codes", "times"))).join(others.withColumnRenamed("codes", "code"), F.col("codes") == F.col("code"))
        rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = scored.select("_row", "n_links", "n_best", "count_sum").unionByName(rare.select("_row", F.lit(0).cast("bigint").alias("n_links"), "n_best", "count_sum"))
    own = cut.select("_row", "doc_id", "own_a", "own_b", "groups", "groups_sha256")
    zero = F.lit(0).cast("bigint")
    every = own.select("*", zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum")).unionByName(sums, allowMissingColumns=True)
    return every.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("own_a").alias("n_a"),
        F.sum("own_b").alias("n_b"),
        F.sum("groups").alias("n_groups"),
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")],
        F.max("groups_sha256").alias("groups_sha256"),
    )


def groups(cut: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``_row, doc_id, group, n_bytes, a_ids, b_ids``: every group of every document, in order from 0.

    A piece emits its groups numbered from its own first one; what stands after its last common end belongs to the next
    piece's first group.  Only such boundary parts are gathered by (row, group).
    """
    shared = _lengths(cut.sparkSession, folder)
    schema = "_row bigint, piece int, part int, whole boolean, n_bytes bigint, a_ids array<int>, b_ids array<int>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            lengths = shared.value
            merged = _merged(batch, lengths)
            own_a, own_b = merged.own_a, merged.own_b
            common = np.intersect1d(merged.ends_a[own_a], merged.ends_b[own_b])
            before = np.searchsorted(common, merged.base)
            out = []
            for r in range(batch.num_rows):
                a, b = slice(merged.limits_a[r], merged.limits_a[r + 1]), slice(merged.limits_b[r], merged.limits_b[r + 1])
                a_ids, b_ids = merged.ids_a[a][own_a[a]], merged.ids_b[b][own_b[b]]
                part_a = np.searchsorted(common, merged.ends_a[a][own_a[a]]) - before[r]
                part_b = np.searchsorted(common, merged.ends_b[b][own_b[b]]) - before[r]
                ended = (before[r + 1] if r + 1 < batch.num_rows else len(common)) - before[r]
                for part in range(max([*part_a[-1:], *part_b[-1:]], default=-1) + 1):
                    x, y = a_ids[np.searchsorted(part_a, part) : np.searchsorted(part_a, part, "right")], b_ids[np.searchsorted(part_b, part) : np.searchsorted(part_b, part, "right")]
                    piece = batch.column("piece")[r].as_py()
                    out.append((batch.column("_row")[r].as_py(), piece, part, (part > 0 or piece == 0) and part < ended, int(lengths[0][x].sum()), x, y))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["_row", "piece", "part", "whole", "n_bytes", "a_ids", "b_ids"])

    parts = cut.select("_row", "piece", "own_a", "own_b", "a_at", "b_at", "a_ids", "b_ids").mapInArrow(split, schema)
    ahead = cut.filter("piece > 0").select("_row").distinct()
    long = cut.join(ahead, "_row", "left_semi").select("_row", F.struct("piece", "groups").alias("p")).groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    running = F.expr("transform(p, (x, i) -> struct(x.piece as piece, aggregate(slice(p, 1, i), 0L, (s, y) -> s + y.groups) as before))")
    offsets = long.select("_row", F.inline(running))
    placed = parts.join(offsets, ["_row", "piece"], "left").withColumn("group", F.col("part") + F.coalesce("before", F.lit(0)))
    names = ["_row", "group", "n_bytes", "a_ids", "b_ids"]
    joined = F.sort_array(F.collect_list(F.struct("piece", "n_bytes", "a_ids", "b_ids")))
    stitched = placed.filter("not whole").groupBy("_row", "group").agg(joined.alias("s")).selectExpr(
        "_row", "`group`", "aggregate(s, 0L, (n, x) -> n + x.n_bytes) as n_bytes", "flatten(s.a_ids) as a_ids", "flatten(s.b_ids) as b_ids"
    )
    ids = cut.filter("piece = 0").select("_row", "doc_id")
    return placed.filter("whole").select(*names).unionByName(stitched).join(ids, "_row").select("_row", "doc_id", *names[1:])


def align(documents: DataFrame, folder: str = FOLDER, size: int = PIECE, head: int = HEAD) -> DataFrame:
    """``link_totals`` of all documents; pieces are stored once, as every later step reads them."""
    cut = stored(pieces(documents, folder, size), "token_pieces")
    return link_totals(cut, pair_counts(cut, folder), folder, head)
