"""Operators with array code in their tasks, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import spaced_words
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join, ngram_lm, quality_classifier, suffix_dedup, tokens


def classes(rows, k, percent):
    """Components by comparing every two sets that share a shingle."""
    sets = {}
    for i, text in rows:
        w = spaced_words(text)
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sets:
        for g in sets[i]:
            holders[g].append(i)
    common = Counter((a, b) for group in holders.values() for a in group for b in group if a < b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 70))] for _ in range(30)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = passage + words[: rng.randint(0, 12)]
        rows.append((i, " ".join(words) if rng.random() > 0.03 else rng.choice([None, "", " \n"])))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_link_classes(documents, k, percent):
    rows = near_copies(random.Random(k), 400)
    table = documents(rows + [(None, "a b c d e"), rows[3]]).selectExpr("*", "1 AS n", "2 AS token")
    got = ngram_join.link_classes(table, k, percent).collect()
    want = classes(rows, k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(
        [(i, *v) for i, v in want.items()] + [(3, *want[3])]
    )
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_document_of_each_class_stays(documents):
    rows = near_copies(random.Random(9), 120)
    kept = ngram_join.keep_one_per_class(documents(rows + [(None, "x"), rows[5]]))
    want = {c for _, c in classes(rows, 5, 80).values()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*want, None]))
    assert ngram_join.link_classes(documents([])).collect() == []


def without_repeats(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + 400] for _, b in raw for p in range(len(b) - 399))
    out = {}
    for i, b in raw:
        marked = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                marked[p : p + 400] = b"\1" * 400
        spans = sum(1 for k, m in enumerate(marked) if m and (k == 0 or not marked[k - 1]))
        out[i] = len(b), sum(marked), spans, hashlib.sha256(bytes(c for c, m in zip(b, marked, strict=True) if not m)).hexdigest()
    return out


@pytest.mark.parametrize(("group", "step"), [(128, 1 << 20), (1, 700)])
def test_suffix_dedup(documents, monkeypatch, group, step):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(rng.randint(60, 120)) for _ in range(5)]
    rows = []
    for i in range(130):
        text = say(rng.randint(0, 200))
        if rng.random() < 0.7:
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(passages)[rng.randint(0, 80) :] + text[at:]
        if rng.random() < 0.15:
            text = rng.choice(["ab", "x"]) * rng.randint(190, 400)
        if rng.random() < 0.1 and rows:
            text = (rng.choice(rows)[1] or "").replace("a", "#", 1)
        rows.append((i, text if rng.random() > 0.02 else None))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(documents(rows)).collect()}
    assert got == without_repeats(rows)


def test_suffix_dedup_of_repeated_rows_and_nothing(documents):
    text = "".join(chr(97 + i * i % 23) for i in range(450))
    got = suffix_dedup.deduplicate(documents([(1, text), (1, text), (None, "short")])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept) for r in got) == [(5, 0, "short"), (450, 450, ""), (450, 450, "")]
    assert suffix_dedup.deduplicate(documents([])).collect() == []


def test_levels_merge_like_binary_digits(spark):
    family = suffix_dedup.LevelFamily()
    found = []
    for heads in ([1, 2], [2, 3, 3], [4], [1, 4, 5], [6]):
        found.append({r.head for r in family.add(spark.createDataFrame([(h,) for h in heads], "head long")).collect()})
    assert found == [set(), {2, 3}, set(), {1, 4}, set()] and sorted(family.levels) == [0, 2]


@pytest.mark.parametrize("how", ["left_semi", "inner"])
def test_suffixes_of_a_common_head_are_dealt_over_several_tasks(spark, how):
    skew = "spark.sql.adaptive.skewJoin."
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    settings |= {f"{skew}skewedPartitionThresholdInBytes": "4k", f"{skew}skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        every = spark.range(0, 20_000, 1, 8).selectExpr("IF(id % 10 = 0, id, 7) AS head", "id")
        twice = every.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head")
        found = suffix_dedup._of_heads(every, twice, how)
        rows = found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.id for r in rows) == [i for i in range(20_000) if i % 10] and {r.head for r in rows} == {7}


def model_scores(rows, prior):
    texts, trained = {}, []
    for i, text in rows:
        w = [*spaced_words(text), "\nend"]
        held = zlib.crc32(str(i).encode()) % 5 == 1
        texts[i] = w, held
        if not held:
            trained.append(w)
    words, arcs, states = Counter(), Counter(), Counter()
    for w in trained:
        words.update(w)
        arcs.update(zip(["\nbegin", *w], w, strict=False))
        states.update(["\nbegin", *w[:-1]])
    total, known = sum(words.values()), len(words)
    out = {}
    for i, (w, held) in texts.items():
        root = [math.log10((words[x] + 0.5) / (total + 0.5 * (known + 1))) for x in w]
        full = sum(
            math.log10((arcs[u, x] + prior * 10**r) / (states[u] + prior)) for u, x, r in zip(["\nbegin", *w], w, root, strict=False)
        )
        out[i] = held, len(w), sum(words[x] > 0 for x in w), total, sum(root), full
    return out


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_language_model(documents, monkeypatch, block):
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    rng = random.Random(8)
    vocabulary = ["The", "the", "cat", "sat", "été", "on", "a", "mat", "x" * 300]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(500, None), (501, " ")]
    got = {r.doc_id: tuple(r)[1:] for r in ngram_lm.score(documents(rows)).collect()}
    want = model_scores(rows, ngram_lm.PRIOR)
    assert set(got) == set(want)
    for i in want:
        assert got[i][:4] == want[i][:4] and got[i][4:] == pytest.approx(want[i][4:], abs=1e-9)


def test_model_prefers_what_it_has_seen(documents):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(40)]
    rows += [(zlib.crc32(b"1") % 1 + 100 + i, "mat the on sat cat the rug the on sat dog the and") for i in range(1)]
    got = {r.doc_id: r for r in ngram_lm.score(documents(rows)).collect()}
    assert got[0].score > got[100].score and got[0].n_tokens == got[100].n_tokens
    assert ngram_lm.score(documents([])).collect() == []


def test_packed_fingerprints_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:2], np.array([0, 1, 2**63, 2**64 - 1], np.uint64), np.sort(keys >> np.uint64(30))):
        some = np.unique(some)
        assert (ngram_lm.unpacked(*ngram_lm.packed(some)) == some).all()


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_words_of_a_batch(monkeypatch, step):
    monkeypatch.setattr(tokens, "STEP", step)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB é\n\t 😀") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "long" * 20]
    data, offsets = tokens.flat(pa.array(texts))
    with np.errstate(over="ignore"):
        starts, ends, prints = tokens.words(data, offsets)
    got = [[] for _ in texts]
    for s, e in zip(starts, ends, strict=True):
        got[np.searchsorted(offsets, s, side="right") - 1].append(bytes(tokens.LOWER[data[s:e]]).decode())
    assert got == [spaced_words(t) for t in texts]
    names = {}
    for word, value in zip((w for t in got for w in t), prints, strict=True):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def graded(spark, n=600):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        kind = rng.choice(["good", "good", "toxic", "poor"])
        if kind == "toxic":
            words[rng.randrange(len(words))] = "vile" + rng.choice("abcd")
        if kind == "poor":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, labels


def test_classifier_on_held_out_rows(spark, documents):
    rows, labels = graded(spark)
    table = spark.createDataFrame(labels[:450] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    extra = documents(rows + [(900, None), (901, ""), (None, "word1 word2")]).selectExpr("*", "1 AS grade", "'k' AS kept")
    got = {r.doc_id: r for r in quality_classifier.classify(extra, table).collect()}
    right = sum(got[i].kept == (q == 1 and t == 0) for i, q, t in labels[450:])
    assert right >= 0.95 * 150 and len(got) == 603
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 for r in got.values())
    kept = quality_classifier.select_documents(extra, table)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_classifier_does_not_depend_on_partitions(spark, documents):
    rows, labels = graded(spark, 200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = (quality_classifier.train(documents(rows).repartition(n), table) for n in (1, 7))
    assert np.array_equal(one.weights, two.weights) and (np.diff(one.thresholds) > 0).all()


def test_classifier_without_labels_keeps_all(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(documents([(1, "a"), (2, None)]), empty).collect()
    assert [(r.expected_grade, r.kept) for r in got] == [(None, True)] * 2


def test_one_of_each_class_stays(spark):
    """Rows are told apart by id and text; null ids take part."""
    base = "one two three four five six seven eight nine ten"
    rows = [
        (1, base, "a"),
        (1, "nothing like the other text of this id at all", "b"),
        (2, base, "c"),
        (None, base, "d"),
        (None, "a text that only rows without an id have", "e"),
        (None, "a text that only rows without an id have", "e"),
        (None, "yet another text", "f"),
        (3, None, "g"),
        (4, None, "h"),
        (4, None, "i"),
        (5, "", "j"),
        (6, "Yet another TEXT", "k"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "1 AS n", "map('a', 1) AS held", "2 AS _first")
    kept = ngram_join.keep_one_per_class(table)
    assert kept.columns == table.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    wanted = [(1, base), (1, rows[1][1]), (None, rows[4][1]), (6, rows[11][1]), (3, None), (4, None), (5, "")]
    assert got == sorted((str(i), str(t)) for i, t in wanted)
    # of rows that repeat id and text the same one stays, however they are dealt
    assert len({r.key for n in (1, 3, 7) for r in ngram_join.keep_one_per_class(table.repartition(n)).filter("doc_id = 4").collect()}) == 1


def test_block_names_repeat(documents):
    """A task that runs again names its blocks as before, and equal blocks of different places differ."""
    rows = [(i % 3, f"some text {i % 3} " * 20) for i in range(60)]
    table = documents(rows).repartition(4, "doc_id").coalesce(2)
    names = [sorted(r.block for r in ngram_lm._ask(table, 4).filter("part is null").collect()) for _ in range(2)]
    assert names[0] == names[1] and len(set(names[0])) == len(names[0])
