"""Words of Arrow text batches as arrays: positions and 64-bit fingerprints, computed for a whole batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer word makes its step longer.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number mod 2^64 and of its inverse."""
    known = _tables.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, STEP + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, base & (2**64 - 1), np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 2**64), np.uint64)
            down[0] = 1
            known = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        _tables[base] = known
    return known


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(data) else data
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of the words; white space and text limits separate them."""
    n = len(data)
    limits = np.unique(offsets)
    starts, ends, prints = [], [], []
    at = 0
    while at < n:
        end = min(n, at + STEP)
        if end < n:  # go on to the next separator
            while True:
                nxt = limits[min(np.searchsorted(limits, end), len(limits) - 1)]
                gap = np.flatnonzero(SPACE[data[end : min(end + 4096, n)]])
                stop = min(nxt, end + gap[0]) if len(gap) else nxt
                if stop - end <= 4096 or len(gap):
                    end = stop
                    break
                end += 4096
        piece = data[at:end]
        solid = ~SPACE[piece]
        cut = np.zeros(len(piece) + 1, bool)
        cut[limits[(limits >= at) & (limits <= end)] - at] = True
        cut[0] = cut[-1] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            up, down = powers(len(piece) + 1)
            values = (LOWER[piece] if fold else piece).astype(np.uint64) + np.uint64(1)
            values *= up[: len(piece)]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values, out=total[1:])
            prints.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(prints)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``text`` holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, held = 0, 0
        for i, b in enumerate(size):
            if held and held + b > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(b)
        if start < batch.num_rows:
            yield batch.slice(start)


def word_limits(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the index of its first word, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def shingles(prints: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``k`` consecutive words of each text, with the limits of each text's; a text of fewer words,
    but not none, has one of them all."""
    counts = np.diff(limits)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_limits = np.concatenate([[0], np.cumsum(sizes)])
    total = int(out_limits[-1])
    if not total:
        return np.zeros(0, np.uint64), out_limits
    first = np.repeat(limits[:-1] - out_limits[:-1], sizes) + np.arange(total)
    width = np.repeat(np.minimum(counts, k), sizes)
    up, _ = powers(k + 1)
    value = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            inside = width > i
            word = prints[np.minimum(first + i, len(prints) - 1)]
            value += np.where(inside, word, np.uint64(0)) * up[i + 1]
        return mixed(value), out_limits


_CODEC = pa.Codec("zstd", compression_level=1)


def packed_sets(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Sorted values below 2^32 of each of ``n`` rows as one compressed binary, so that a batch of many long sets stays
    small in the JVM; ``row`` is sorted."""
    steps = np.diff(values, prepend=0).astype(np.int64)
    limits = np.searchsorted(row, np.arange(n + 1)).tolist()
    first = [i for i, j in zip(limits[:-1], limits[1:], strict=True) if j > i]
    steps[first] = values[first]
    raw = steps.astype("<u4")
    runs = [raw[i:j].tobytes() for i, j in zip(limits[:-1], limits[1:], strict=True)]
    return pa.array([len(r).to_bytes(8, "little") + _CODEC.compress(r, asbytes=True) if r else b"" for r in runs], pa.binary())


def unpacked_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``row, value`` of a column of packed sets; null counts as empty."""
    rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, r in enumerate(column.to_pylist()):
        if r:
            held = np.cumsum(np.frombuffer(_CODEC.decompress(r[8:], int.from_bytes(r[:8], "little"), asbytes=True), "<u4").astype(np.int64))
            rows.append(np.full(len(held), i))
            values.append(held)
    return np.concatenate(rows), np.concatenate(values)
