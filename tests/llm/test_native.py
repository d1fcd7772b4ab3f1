"""Operators of DataFrame functions: small cases, brute force, and no Python in their plans."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, mixing, pii, quality_rules, sharding, url_rules

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_digest(text):
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if fits(kind, m.group())
    ]
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))
    return hashlib.sha256(joined.encode()).hexdigest()


def test_base_spans_equal_plain_search(documents):
    rng = random.Random(1)
    parts = ["a", "b1", "@", ".", "..", "+", "4", "12", "255", "256", "1.2.3.4", ".5", "a@b.c", "_x@d.e.", "-", " ", "(", ")", "\n", "é", "😀",
             "4111111111111111", "+49 (30) 1234567", " 4000 0000 0000 0002", "@x.y", "%", "+1", "99"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(-1, None), (-2, ""), (-3, "a@b.c " * 2000), (-4, "1" * 50000), (-5, "a" * 50000 + "@"), (-6, "x@a" + ".a" * 20000)]
    got = {r.doc_id: r.base_sha256 for r in pii.digest(pii.find(documents(rows))).collect()}
    assert got == {i: base_digest(t) for i, t in rows}


def test_a_term_that_only_stands_by_one_address_is_added(documents):
    filler = "plain words about many other things in ordinary lines of text again and again "
    rows = [(i, f"{filler}{i}\nzorblatt wrote from zed@mail.example number {i * 7}\n{filler}") for i in range(5)]
    rows += [(100 + i, filler * 20) for i in range(30)] + [(200, filler * 3), (None, None)]
    found = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert {a.term for a in found[0].added} == {"zorblatt"} or "zorblatt" in {a.term for a in found[0].added}
    assert found[100].added == [] and found[200].added == [] and found[None].found == []
    text = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert "zed@mail" not in text[0] and "[EMAIL]" in text[0] and "zorblatt" not in text[0]
    assert text[100] == filler * 20


def test_texts_are_cut_by_their_own_spans(documents):
    """Rows that share an id keep apart; rows without an id too."""
    rows = [(1, "write to ann@mail.example today"), (1, "the quick brown fox jumps over it"), (None, "call +49 30 1234567 8"), (None, "nothing"), (2, None)]
    plain = [(100 + i, "write to today the quick brown fox jumps over it call nothing") for i in range(200)]
    got = [(r.doc_id, r.text) for r in pii.sanitise(documents(rows + plain).selectExpr("*", "1 AS row", "2 AS found")).collect()]
    assert Counter(got) == Counter(
        [(1, "write to [EMAIL] today"), (1, rows[1][1]), (None, "call [PHONE]"), (None, "nothing"), (2, "")] + plain
    )


def disclosed(rows):
    """Removed and generalised places by document counts, term by term; texts hold no CJK runs of over three letters."""
    texts = {i: t or "" for i, t in rows}
    words = {i: {w for m in re.findall(r"[^\W\d_]+", t) for w in {m.lower(), *re.findall("(?=([一-鿿]{2}))", m)}} for i, t in texts.items()}
    mails = {i: {m.group().lower() for m in re.finditer(BASE["email"], t)} for i, t in texts.items()}
    out = {}
    for i, t in texts.items():
        best = {}
        for w in words[i]:
            n = sum(w in x for x in words.values())
            for e in mails[i]:
                p = min(sum(e in x for x in mails.values()) / len(texts), 0.5)
                both = sum(w in words[j] and e in mails[j] for j in texts)
                best[w] = max(best.get(w, 0), 1 - math.log(both / n) / math.log(p))
        inside = {k for m in re.finditer(BASE["email"], t) for k in range(*m.span())}
        places = {(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)} | {m.span(1) for m in re.finditer("(?=([一-鿿]{2}))", t)}
        out[i] = sorted(
            (a, b, t[a:b].lower(), "remove" if best[t[a:b].lower()] >= 0.97 else "generalise")
            for a, b in places
            if best.get(t[a:b].lower(), 0) >= 0.90 and not inside & set(range(a, b))
        )
    return out


def test_terms_disclose_in_whole_documents(documents):
    rng = random.Random(5)
    common = "plain words about many other things in ordinary lines of text again".split()
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, say(60)) for i in range(60)]
    rows += [(100 + i, f"Ann Lee\nann.l@firm.example\n{say(80)}\n{say(5)} Lee {say(3)} 王明 {say(1)}") for i in range(4)]
    rows += [(200, f"Bo {say(50)}\n{say(9)} once@seen.example {say(70)}\n{say(40)} quorl"), (300, f"lee {say(20)}"), (301, f"{say(9)} 王明")]
    rows += [(400 + i, f"rare{i % 9} {say(4)} x{chr(97 + i % 7)}@pool.example {say(2)} tale {chr(97 + i % 5) * 2}") for i in range(30)]
    rows += [(500, None), (501, "")]
    got = {r.doc_id: [tuple(a) for a in r.added] for r in pii.find(documents(rows)).collect()}
    assert got == disclosed(rows)
    assert {a[2] for a in got[100]} >= {"ann", "lee", "王明"} and {a[2] for a in got[200]} == {"bo", "quorl"} and got[300] == []


def test_digits_and_markup_do_not_shift_disclosure(documents):
    texts = [f"{i} zorb z@mail.example" for i in range(8)] + ["zorb"] * 2 + ["plain words here again"] * 5
    pad = " <0123456789>" * 300
    added = [
        {r.doc_id: [(a.term, a.action) for a in r.added] for r in pii.find(documents([(i, t + p) for i, t in enumerate(texts)])).collect()}
        for p in ("", "\n" + pad)
    ]
    assert added[0] == added[1]


def words13(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 4000, 0])  # windows fit, only their hashes fit, nothing fits
def test_contamination_equals_plain_scan(spark, documents, broadcast_bytes):
    rng = random.Random(2)
    vocabulary = ["Alpha", "beta", "x1", "été", "É", "of", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (3, say(5)), (4, None), (5, ""), (None, say(14)), (12, say(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{say(rng.randint(0, 30))}, {rng.choice(items)[1] or ''}. {say(rng.randint(0, 60))}") for i in range(60)]
    rows += [(900, None), (901, ""), (None, items[1][1]), (7, rows[7][1])]
    grams = {}
    for item, text in items:
        w = words13(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    want = []
    for doc, text in rows:
        w, hit, held = words13(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    held |= grams[tuple(w[i : i + n])]
        want.append((doc, len(w), len(hit), sorted(str(x) for x in held - {None}), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.contamination(documents(rows), bench, broadcast_bytes=broadcast_bytes).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = decontamination.remove_documents(documents(rows).withColumn("hit", F.lit(1)), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want if not r[4]) and kept.columns == ["doc_id", "text", "hit"]
    empty = bench.filter("false")
    assert not any(r.contaminated for r in decontamination.contamination(documents(rows), empty).collect())


def test_removed_spans_leave_the_rest(spark, documents):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"Before, it. {item}! After\nit"), (2, "nothing here"), (3, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = {r.doc_id: r.text for r in decontamination.remove_spans(documents(rows), bench).collect()}
    assert text == {1: "Before, it. After\nit", 2: "nothing here", 3: None}


def test_removed_spans_of_rows_that_repeat_an_id(spark, documents):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"a {item} b {item}"), (1, f"{item}"), (1, "clean text"), (None, f"{item} c"), (None, f"{item} c"), (2, f"{item} " * 400 + "d")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.text.strip()) for r in decontamination.remove_spans(documents(rows), bench).collect())
    assert got == sorted([("1", "a b"), ("1", ""), ("1", "clean text"), ("None", "c"), ("None", "c"), ("2", "d")])


def test_windows_of_large_benchmarks_travel_without_words(spark, documents):
    """Beyond the broadcast no exchange by hash carries the words of a document."""
    words = documents([(1, "a b c")]).selectExpr("doc_id", "1L AS text_hash", "split(text, ' ') AS words")
    grams = decontamination.benchmark_windows(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    seen, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored = decontamination.stored
    try:
        decontamination.stored = lambda frame, name: (seen.append(frame._jdf.queryExecution().executedPlan().toString()), stored(frame, name))[1]
        decontamination._scan_many(words, grams, [3], 0)
    finally:
        decontamination.stored = stored
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    places = seen[0]
    assert "hashpartitioning(gram_hash" in places
    assert not any("words#" in line for line in places.splitlines() if "Exchange" in line)
    generated = next(line for line in places.splitlines() if "Generate posexplode" in line)
    assert "words#" not in generated.split("posexplode")[1].split("]")[0]


def rule_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_rule_counts_equal_plain_counts(documents):
    rng = random.Random(3)
    parts = ["a", "b", "the", "é😀", "#", "\n", "\n\n", " ", "\t", "\u00a0", "x<y", "c d e ", "|"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(-1, None), (-2, ""), (-3, "a b c " * 40000), (-4, "\n" * 1000), (-5, "a b"), (-6, "a a a")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(documents(rows)).collect()}
    assert got == {i: rule_counts(t) for i, t in rows}


def test_windows_with_one_hash_are_told_apart(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(-1, "a b c x y z a b c")]
    words = documents(rows).select("doc_id", F.regexp_extract_all("text", F.lit(quality_rules.WORD), F.lit(0)).alias("words"))
    for hash in ("0L", "cast(ascii(w[i]) % 2 as bigint) * 1000000", quality_rules.HASH):
        got = {r.doc_id: r.n for r in words.select("doc_id", F.expr(quality_rules.repeated_words(hash)).alias("n")).collect()}
        assert got == {i: rule_counts(t)[4] for i, t in rows}


@pytest.mark.parametrize("hot", [0, 300])
def test_shards_are_even_and_slots_gapless(documents, hot):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 90)) for i in range(900)] + [(1000 + i, "same text " * 4) for i in range(hot)]
    rows += [(None, None), (5, "twice"), (5, "twice")]
    table = documents(rows).withColumn("shard", F.lit("old")).withColumn("_h", F.lit(1))
    out = sharding.shard_documents(table).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        assert r["size"] == len(r.text or "") + 1 and r.law == "bytes" and r._h == 1
        by_shard.setdefault(r.shard, []).append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by_shard.items()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * 91
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())


def test_equal_texts_stay_together_where_size_allows(documents):
    rows = [(i, f"text {i % 300} " + "y" * (i % 300 % 7)) for i in range(3000)]
    shards = {}
    for r in sharding.shard_documents(documents(rows)).collect():
        shards.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_no_documents_no_shards(documents):
    assert sharding.shard_documents(documents([])).collect() == []


def test_shortage_goes_to_siblings_first():
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    given = mixing.budgets(supply, mixing.Weights(), 800, 1.0)
    # half for each domain, a quarter of all for each language of a; source 2 takes what source 1 lacks
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}
    given = mixing.budgets({**supply, ("a", "x", "2"): 20}, mixing.Weights(), 800, 1.0)
    # the family a-x is short, so a-y takes it; b keeps its share
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "1"): 370, ("b", "x", "1"): 400}
    given = mixing.budgets({**supply, ("b", "x", "1"): 100}, mixing.Weights(), 800, 1.0)
    assert given[("b", "x", "1")] == 100 and sum(given.values()) == pytest.approx(800)
    assert mixing.budgets({}, mixing.Weights(), 800, 1.0) == {}


def test_a_tree_that_cannot_supply_its_budget_gives_all_it_has():
    weights = mixing.Weights({("a",): 0.1, ("a", "x"): 0.3, ("a", "x", "1"): 0.1, ("a", "x", "2"): 0.2})
    for n in range(1, 400):
        supply = {("a", "x", "1"): n, ("a", "x", "2"): 7 * n + 1}
        assert mixing.budgets(supply, weights, 10.0 * n + 1, 1.0) == supply
        assert mixing.budgets({("a", "x", "1"): n}, weights, 9.0 * n, 3.0) == {("a", "x", "1"): 3 * n}


def mix_table(spark, n=600):
    rows = [(i, "w " * (i % 13), ["en", "de", None][i % 3], f"src{i % 20}") for i in range(n)]
    rows += [(None, None, None, None), (1, "a b", "en", "src1"), (1, "a b", "en", "src1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mix_takes_whole_epochs_and_a_prefix(spark):
    table = mix_table(spark)
    leaf = ["domain", "lang", "source"]
    taken = mixing.mix(table, fraction=1.3, max_epochs=3.0).collect()
    again = mixing.mix(table.repartition(7), fraction=1.3, max_epochs=3.0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_hash, r.epoch)
    assert sorted(map(tuple, taken), key=str) == sorted(map(tuple, again), key=str)
    supply = Counter()
    for r in mixing.mix(table, fraction=1.0, max_epochs=1.0, weights=mixing.Weights()).collect():
        supply[tuple(r[c] for c in leaf)] += r.n_tokens
    wanted = mixing.budgets(dict(supply), mixing.TARGETS, 1.3 * sum(supply.values()), 3.0)
    got = Counter()
    for r in taken:
        got[tuple(r[c] for c in leaf)] += r.n_tokens
    assert all(0 <= wanted[p] - got[p] <= 13 for p in wanted if wanted[p] < 3 * supply[p])
    assert max(r.epoch for r in taken) >= 1 and key(taken[0])


def test_mixed_documents_keep_their_columns(spark):
    table = mix_table(spark, 60).withColumn("count", F.lit(9))
    out = mixing.mix_documents(table, fraction=1.0, max_epochs=1.0, weights=mixing.Weights())
    assert out.columns == table.columns and out.count() == table.count()
    assert mixing.mix_documents(table.filter("false")).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://Blog.Example.ORG/en/12#x", "example.org/en/1", "block"),
        (2, "http://example.org/en/2?x=/en/1", "org/", "allow"),
        (3, "http://example.org", None, "allow"),
        (4, "http://notexample.org/es/1", "org/", "allow"),
        (5, "x://a.com/de/?q", "com/de/", "block"),
        (6, "http://free-bets.example.net/en/1", None, "block"),
        (7, "http://my.net/online/casino.html", None, "block"),
        (8, "http://casinos.net/", None, "allow"),
        (9, None, None, "allow"),
        (10, "no scheme/fr/", None, "allow"),
        (None, "http://fr.com/fr/", "com/fr/", "allow"),
        (11, "http://example.org/es/a", "example.org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u, *_ in rows], "page_id long, url string, host int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages).collect()}
    assert got == {i: (rule, verdict) for i, _, rule, verdict in rows}
    assert url_rules.judge_urls(pages.filter("false")).count() == 0


def test_main_paths_run_no_python(spark, sf_dir):
    from ledgerloom.llm.queries import QUERIES

    for name in ("op1_decontamination", "op3_pii", "op5_sharding", "op8_url_rules", "op9_quality_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan), name
