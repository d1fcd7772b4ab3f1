"""Importance resampling against sums word by word."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from brute import ascii_lower

from ledgerloom.llm import importance_resampling as ir


def runs(text, n):
    words, word = [], ""
    for c in ascii_lower(text) + " ":
        if c.isascii() and not (c.isdigit() or c.isalpha()):
            words += [word] if word else []
            word = ""
        else:
            word += c
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, n, buckets, percent, least):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(map(place, runs(text, n)[1]))
    for _, text in target:
        wanted.update(map(place, runs(text, n)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for doc_id, text in rows:
        n_words, found = runs(text, n)
        weight = sum(gain(place(f)) for f in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n_words])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(rng, n=300):
    words = ["alpha", "Beta", "Élan", "x", "42", "q_r", "漢字", "o'neil", "Straße", "delta" * 12] + [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 60])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " ,;- "), (None, "no id " * 30), (None, None)]


TARGET = [("a", "alpha beta alpha"), ("b", "Élan w1 w2"), (None, None), ("c", "")]


@pytest.mark.parametrize(("n", "head"), [(1, 0), (1, 5), (2, 8), (2, 20_000), (3, 10)])
def test_resample(spark, documents, n, head):
    rows = rows_of(random.Random(n))
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    table = documents(rows).selectExpr("*", "1 AS n", "2 AS score", "3 AS bucket")
    got = ir.resample(table, target, n=n, buckets=97, percent=30, head_size=head)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == plain(rows, TARGET, n, 97, 30, 20)


def test_rows_that_repeat_an_id(spark, documents):
    rows = [(i % 4, "same words here " * 10) for i in range(40)]
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    ranks = sorted(r["rank"] for r in ir.resample(documents(rows), target, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 21))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "too short")]])
def test_nothing_to_draw(spark, documents, rows):
    empty = spark.createDataFrame([], "item_id string, text string")
    got = ir.resample(documents(rows), empty).collect()
    assert len(got) == len(rows) and all(r["rank"] is None for r in got)


def test_head_holds_exact_states(documents):
    rows = rows_of(random.Random(3))
    assert len(ir.vocabulary_head(documents(rows), 2, 97, 10).states) <= 10
    head = ir.vocabulary_head(documents(rows), 2, 97, 40)
    assert len(head.states) <= 40 and len(head.pairs) <= 40
    every = Counter(w for _, t in rows for w in runs(t, 1)[1])
    top = {w.encode() for w, c in every.items() if c > sorted(every.values())[-40]}
    assert {w for w in top if len(w) <= ir.HEAD_BYTES} <= set(head.states)
    assert all(zlib.crc32(w) == s for w, s in head.states.items())
    assert all(zlib.crc32(a + b" " + b) % 97 == k for (a, b), k in head.pairs.items())
