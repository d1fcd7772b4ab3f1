"""Token alignment against overlaps found token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import token_alignment as ta

TEXTS = [
    None,
    "",
    " ",
    "a",
    "Hello world, hello  worlds.\n\nTab\there",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "▁ is a sign of its own",
    "naïve ﬁne ① é 漢字かな交じり 🙂🙂  x​y",
    "  leading and trailing  ",
    "\x00\x01 control \r\n",
    "der schnelle braune fuchs " * 40,
    "unbelievablyhyperextraordinarinesses" * 30,
]


@pytest.fixture(scope="module")
def know():
    """Both tokenizers, and the libraries that the files are made for."""
    from tokenizers import Tokenizer

    made = ta.load()
    made.a = Tokenizer.from_str(made.file_a.decode())
    made.a.encode_special_tokens = True
    return made


def spans(ids, entries):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(entries[i]), i))
        at += len(entries[i])
    return out


def plain(rows, know):
    """Every pair of tokens compared by their byte ranges."""
    found, count = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = know.a.encode(" " + text, add_special_tokens=False).ids
            b = know.b.encode(text)
            whole = (" " + text).encode()
            if b"".join(know.bytes_a[i] for i in a) != whole or b"".join(know.bytes_b[i] for i in b) != whole:
                a = b = []
        sa, sb = spans(a, know.bytes_a), spans(b, know.bytes_b)
        links, j = [], 0
        for x, y, i in sa:
            while j and sb[j - 1][1] > x:
                j -= 1
            for u, v, k in sb[j:]:
                if u >= y:
                    break
                if v > x:
                    links.append((i, k))
                j += 1
        count.update(links)
        common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        low, groups = 0, []
        for end in common:
            groups.append(([i for x, _, i in sa if low <= x < end], [i for x, _, i in sb if low <= x < end]))
            low = end
        found.append((doc_id, len(a), len(b), links, groups))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, links, groups in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        good = sum(count[p] == best[p[1]] for p in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), good, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), found, count, best


def rows_of(rng):
    words = ["the", "Brown", "überqualifiziert", "x1", "don't", "漢字", "running", "...", "🙂"]
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    rows = list(enumerate(TEXTS + long))
    return rows + [(None, "a null id"), rows[10], (3, "another text of one id")]


@pytest.mark.parametrize(("size", "head"), [(5, 0), (64, 40), (ta.PIECE, ta.HEAD)])
def test_totals(documents, know, size, head):
    rows = rows_of(random.Random(size))
    table = documents(rows).selectExpr("*", "1 AS piece", "'x' AS _row", "2 AS code")
    got = ta.align(table, size=size, head=head)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == plain(rows, know)[0]


def test_pieces_hold_equal_work(documents, know):
    text = "word " * 500
    cut = ta.pieces(documents([(1, text), (2, "unbelievablyhyperextraordinarinesses" * 40)]), size=50).collect()
    for r in cut:
        assert r["own_a"] + r["own_b"] <= 51  # a tie moves behind the cut
    assert sum(r["piece"] == 0 for r in cut) == 2 and len(cut) > 20


def test_groups_are_stitched(spark, documents, know):
    rows = rows_of(random.Random(9))
    cut = ta.pieces(documents(rows), size=7)
    got = defaultdict(list)
    for r in ta.groups(cut).orderBy("_row", "group").collect():
        got[r["_row"]].append((r["group"], r["a_ids"], r["b_ids"]))
        assert r["n_bytes"] == sum(len(know.bytes_a[i]) for i in r["a_ids"]) == sum(len(know.bytes_b[i]) for i in r["b_ids"])
    expected = sorted([(g, *pair) for g, pair in enumerate(groups)] for *_, groups in plain(rows, know)[1] if groups)
    assert sorted(got.values()) == expected


def test_pair_counts(documents, know):
    rows = rows_of(random.Random(2))
    counts = ta.pair_counts(ta.pieces(documents(rows), size=30)).select(*ta.code_ids(), "n", "best")
    _, _, count, best = plain(rows, know)
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in counts.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_head_is_bounded(documents):
    counts = ta.pair_counts(ta.pieces(documents(rows_of(random.Random(4)))))
    for limit in (0, 3, 50):
        head, rest = ta._head(counts, limit)
        assert head.count() <= limit
        assert head.count() + rest.count() == counts.count()


def test_empty_table(documents):
    assert ta.align(documents([])).count() == 0


@pytest.mark.parametrize("size", [1, 20, 100])
def test_parts_of_a_long_text(know, size):
    rng = random.Random(size)
    words = ["don't", "a", "Ünder", "漢字", "1999", "...", "x\n", "  ", "\t", "end.", "🙂"]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(60))
        parts = ta.split_parts(text, size)
        assert " ".join(parts) == text and (size < 100 or len(parts) > 1)
        joined = [i for p in parts for i in know.a.encode(" " + p, add_special_tokens=False).ids]
        assert joined == know.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in know.b.encode(p)] == know.b.encode(text)


def test_encoding_word_by_word_equals_encoding_whole_texts(know):
    rng = random.Random(4)
    words = ["don't", "a", "Ünder", "漢字", "1999", "...", "x\n", "  ", "\t", "end.", "🙂", "'s", ",", "e\u0301", "\u00a0", "\u3000", "-", "\x1c", "\x85", "ﬁ", "¨", "\u0308"]
    texts = [None, "", " "] + [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for few in ([t for t in texts if t is None or "ﬁ" not in t], texts):
        (ids_a, at_a), (ids_b, at_b) = know.encode(few)
        for i, t in enumerate(few):
            a, b = (know.a.encode(" " + t, add_special_tokens=False).ids, know.b.encode(t)) if t else ([], [])
            whole = (" " + t).encode() if t else b""
            same = b"".join(know.bytes_a[k] for k in a) == whole == b"".join(know.bytes_b[k] for k in b)
            assert ids_a[at_a[i] : at_a[i + 1]].tolist() == (a if same else [])
            assert ids_b[at_b[i] : at_b[i + 1]].tolist() == (b if same else [])


def test_no_piece_crosses_a_cut(know):
    """What lets a text be cut: a space stands only first in an entry, or among spaces."""
    for entry in know.bytes_b:
        assert b" " not in entry.lstrip(b" ")


def test_ranks_give_the_librarys_ids(know):
    """Also for every character beside letters, digits, spaces and itself."""
    assert know._vocabulary[2]
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{c}b {c} 1{c}2  {c}{c}.{c}'s \n{c} {c}x" for c in every[:0x3000] + every[0x3000::17]]
    expected = know.a.encode_batch_fast(texts, add_special_tokens=False)
    assert all(know.encode_a(t).tolist() == e.ids for t, e in zip(texts, expected, strict=True))


def test_other_files_are_left_to_their_library(know):
    import json

    file = json.loads(know.file_a)
    file["pre_tokenizer"]["add_prefix_space"] = True
    other = ta.Tokenizers(json.dumps(file).encode(), know.file_b)
    assert not other._vocabulary[2]
    assert other.encode_a("word").tolist() == know.encode_a(" word").tolist()


def test_merge_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(1, 60, rng.integers(0, 40)))
        b = np.unique(rng.integers(1, 60, rng.integers(0, 40)))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        d = np.arange(len(merged) + 1)
        i, j = ta.merge_cuts(a, b, d)
        for k in d:
            tie = 0 < k < len(merged) and merged[k - 1][0] == merged[k][0]
            first = merged[: k + tie]
            assert (i[k], j[k]) == (sum(s == 0 for _, s in first), sum(s == 1 for _, s in first))
