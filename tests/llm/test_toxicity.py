"""Toxicity: gradient and swaps against plain restatements, held-out accuracy, fewer false alarms by the regulariser."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import toxicity as tx

DATA = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(3)
    rows, columns = rng.integers(0, 12, 60), rng.integers(0, 7, 60)
    twin = rng.integers(0, 4, 20), rng.integers(0, 7, 20), rng.choice([-1.0, 1.0], 20)
    toxic, weights = rng.integers(0, 2, 12), rng.normal(size=7)
    value = lambda w, b: tx.loss(w, b, rows, columns, toxic, *twin, 4, 0.7)
    # the loss itself, row by row
    total = 0.0
    for i in range(12):
        z = sum(weights[c] for r, c in zip(rows, columns, strict=True) if r == i) + 0.3
        total += np.log1p(np.exp(-z)) if toxic[i] else np.log1p(np.exp(z))
    change = [sum(s * weights[c] for r, c, s in zip(*twin, strict=True) if r == i) for i in range(4)]
    assert value(weights, 0.3)[0] == pytest.approx(total / 12 + 0.7 * np.mean(np.square(change)))
    _, gradient, slope = value(weights, 0.3)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert gradient[k] == pytest.approx((value(weights + step, 0.3)[0] - value(weights - step, 0.3)[0]) / 2e-6, abs=1e-6)
    assert slope == pytest.approx((value(weights, 0.3 + 1e-6)[0] - value(weights, 0.3 - 1e-6)[0]) / 2e-6, abs=1e-6)


def plain_features(text):
    words, word = set(), b""
    for b in (text or "").encode() + b" ":
        if chr(b).isalnum() and b < 128 or b >= 128:
            word += bytes([b + 32]) if 65 <= b <= 90 else bytes([b])
        else:
            words |= {(99, word)} | {(n, word[:n]) for n in tx.HEADS if len(word) >= n} if word else set()
            word = b""
    return words


def test_features():
    texts = ["", None, "The cat, the CAT; thé!", "a", "### x$$$ cat\ncat", "über-cat", "z" * 5000, "catalogue " * 3]
    row, column = tx.features(pa.array(texts, pa.string()))
    expected = [plain_features(t) for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(e) for e in expected]
    sets = [set(column[row == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(expected):
        for j, b in enumerate(expected):
            assert len(sets[i] & sets[j]) == len(a & b)
    chosen = np.zeros(1 << tx.BITS, bool)
    chosen[column[::3]] = True
    r, c = tx.features(pa.array(texts, pa.string()), chosen)
    assert list(zip(r, c, strict=True)) == [(x, y) for x, y in zip(row, column, strict=True) if chosen[y]]


def test_features_do_not_depend_on_neighbours():
    texts = [f"word{i} and others {'x' * i}" for i in range(50)]
    row, column = tx.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert column[row == i].tolist() == tx.features(pa.array([t]))[1].tolist()


def test_swaps():
    swaps = tx.Swaps((("red", "green", "blue"), ("cat", "dog"), ("alone",)))
    assert swaps.swapped("nothing here") is None and swaps.swapped(None) is None and swaps.swapped("") is None
    assert swaps.swapped("reddish hundred") is None
    for text in ("Red cats like a red cat.", "a DOG, a blue dog", "green"):
        twin = swaps.swapped(text)
        old, new = text.lower().rstrip(".").replace(",", "").split(), twin.rstrip(".").replace(",", "").split()
        for a, b in zip(old, new, strict=True):
            group = next((g for g in swaps.groups if a in g), None)
            assert (b in group and b != a) if group else a.lower() == b.lower()
    assert swaps.swapped("alone") == "alone"
    assert tx.Swaps(()).swapped("red") is None


def biased(rng, n):
    """Abuse that often names one group, and neutral texts, some of which name a group too."""
    plain, rows, labels = [f"n{i}" for i in range(200)], [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(25)]
        toxic = rng.random() < 0.4
        if toxic:
            words[3] = rng.choice(["vile", "filthy", "rotten"])
            words[7] = "muslims" if rng.random() < 0.8 else rng.choice(["christians", "buddhists"])
            if rng.random() < 0.3:
                words[3] = "n1"  # abuse told by nothing but the company of the name
        elif rng.random() < 0.1:
            words[7] = "christians"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_fewer_false_alarms_on_neutral_mentions(spark, documents):
    rows, labels = biased(random.Random(5), 1500)
    table, known = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rng = random.Random(6)
    neutral = [(10_000 + i, " ".join(f"n{rng.randrange(200)}" for _ in range(20)) + " muslims") for i in range(200)]
    abuse = [(20_000 + i, " ".join(f"n{rng.randrange(200)}" for _ in range(20)) + f" {w} christians") for i, w in enumerate(["vile", "filthy", "rotten"] * 30)]
    alarms, caught = {}, {}
    for weight in (0.0, tx.SWAP_WEIGHT):
        model = tx.train(table, known, swap_weight=weight)
        alarms[weight] = np.mean([r["predicted"] for r in tx.score(documents(neutral), model).collect()])
        caught[weight] = np.mean([r["predicted"] for r in tx.score(documents(abuse), model).collect()])
    assert alarms[0.0] > 0.5 and alarms[tx.SWAP_WEIGHT] < 0.1
    assert caught[tx.SWAP_WEIGHT] > 0.9


def test_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in tx.classify(documents, labels).collect()}
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    # labels of held-out rows have no part in the model
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r["doc_id"]: r["score"] for r in tx.classify(documents, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    right = [got[i]["predicted"] == t for i, t in known.items() if got[i]["held_out"]]
    assert np.mean(right) > 0.9


def test_defined_cases(spark, documents):
    rows = [(i, f"vile thing {i}" if i % 2 else f"fine thing {i}") for i in range(100)] + [(None, "vile"), (None, None), (7, None), (7, ""), (8, "x" * 300_000)]
    labels = [(i, 1, i % 2) for i in range(100)] + [(None, 1, 1), (3, 1, None), (4, 1, 0)]
    table = documents(rows).selectExpr("*", "0 AS toxic", "1 AS at", "'y' AS lang", "2 AS columns")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS text")
    got = tx.classify(table, known).collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    empty = known.limit(0)
    assert {r["score"] for r in tx.classify(table, empty).collect()} == {tx._sigmoid(np.array([-40.0]))[0]}
    assert {r["predicted"] for r in tx.classify(table, known.filter("toxic = 1")).collect()} == {1}
    assert tx.classify(documents([]), known).count() == 0
