"""Markup to trees: shapes of malformed markup, ranges, references, and the canonical form."""

import html
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import html_tokens
from ledgerloom.operators import nodes
from ledgerloom.operators.nodes import bound, markup_tokens, node_html, parse_html


def parsed(spark, documents):
    """Rows with ``nodes``, ``doc_text`` and ``written``, the canonical markup of every element."""
    frame = parse_html(spark.createDataFrame(list(enumerate(documents)), "k int, html string"))
    doc = F.col("doc_html")
    every = bound(
        markup_tokens(doc), lambda tokens: F.transform("nodes", lambda n: F.when(n["kind"] == "element", node_html(doc, tokens, n)))
    )
    return frame.select("k", "doc_text", "nodes", every.alias("written")).orderBy("k").collect()


def whole(row):
    return next(w for w, n in zip(row.written, row.nodes) if n.tag == "html")


SHAPES = [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p>a<b>b<p>c", "<p>a<b>b</b></p><p><b>c</b></p>"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<b>1<i>2</b>3</i>4", "<b>1<i>2</i></b><i>3</i>4"),
        ("<p><font><div>q</font></div>z", "<p><font></font></p><div><font>q</font></div>z"),
        ("<h2>a<h3>b</h3>", "<h2>a</h2><h3>b</h3>"),
        ("<table><tr><td>a<td>b</table>", "<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>"),
        ("<table>x<tr><td>a</table>", "x<table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><tr><td><b>x</td><td>y</table>z",
         "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<dl><dt>a<dd>b</dl>", "<dl><dt>a</dt><dd>b</dd></dl>"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("a<br/>b<hr>", "a<br>b<hr>"),
        ("x</p>y", "x<p></p>y"),
        ("<p>cut <i", "<p>cut </p>"),
        ("&amp;nbsp; &nbsp;&lt;&copy;", "&amp;nbsp; &nbsp;&lt;©"),
        ("<i title='a\"b' id=q>k</i>", '<i title="a&quot;b" id="q">k</i>'),
        ("<a href='?a=1&copy=2'>x</a>", '<a href="?a=1&amp;copy=2">x</a>'),
        ("<DIV CLASS=Toc>x</DIV>", '<div class="Toc">x</div>'),
        ("<script>a<b && c</script>", "<script>a<b && c</script>"),
        ("<pre>\n a</pre>", "<pre> a</pre>"),
        ("<textarea>\n\na &lt;b></textarea>", "<textarea>\na &lt;b&gt;</textarea>"),
        ("<td>a</td><TITLE>x &amp; <b></title>", "a<title>x &amp; &lt;b&gt;</title>"),
        ("a < b <3 &#x1F600;&#128;&#0;&notit;&bogus;", "a &lt; b &lt;3 😀€\ufffd¬it;&amp;bogus;"),
        ("<x y='>' z=a/b q>k</X>", '<x y=">" z="a/b" q="">k</x>'),
        ("<i id=a ID=b class='c&amp;\u00a0d'>k</i>", '<i id="a" class="c&amp;&nbsp;d">k</i>'),
        ("<!-- a --><!b><?c></ d></><!-->e", "<!-- a --><!--b--><!--?c--><!-- d--><!---->e"),
        ("x\r\ny\rz\0", "x\ny\nz"),
        ("<script>a</scripty></SCRIPT x>b", "<script>a</scripty></script>b"),
        ("<noscript><p>&lt;</noscript>", "<noscript>&lt;p&gt;&amp;lt;</noscript>"),
        ("<font size=1 color=r>a<p><font color=r size=1>b<p>c", None),
]


def test_shapes(spark):
    rows = parsed(spark, ["<body>" + markup for markup, _ in SHAPES])
    got = [re.search(r"(?s)<body>(.*)</body>", whole(r))[1] for r in rows]
    assert [(m, g) for (m, want), g in zip(SHAPES, got) if want is not None] == [x for x in SHAPES if x[1] is not None]


def test_skeleton_is_implied_and_flagged(spark):
    bare, spelled = parsed(spark, ["x", "<html><head><title>t</title></head><body>x</body></html>"])
    assert whole(bare) == "<html><head></head><body>x</body></html>"
    assert [(n.tag, n.implied) for n in bare.nodes[:3]] == [("html", True), ("head", True), ("body", True)]
    assert not any(n.implied for n in spelled.nodes)


def test_quirks_mode_keeps_a_table_in_its_paragraph(spark):
    markup = "<body><p><table></table>"
    old = '<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">'
    got = [whole(r) for r in parsed(spark, [markup, "<!DOCTYPE html>" + markup, old + markup])]
    assert ["<p><table>" in g for g in got] == [True, False, True]


def test_missing_and_empty_markup(spark):
    missing, empty = parsed(spark, [None, ""])
    assert missing.doc_text is None and not missing.nodes
    assert whole(empty) == "<html><head></head><body></body></html>"


PIECES = (
    ["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<div class=x>", "</div>", "<table>", "<tr>", "<td>", "</td>",
     "</table>", "<h2>", "</h2>", "<a href=u>", "</a>", "<li>", "<ul>", "</ul>", "text ", "é&amp;", "<!-- c -->",
     "<br>", "<span>", "</span>", "<font>", "</font>", "<", "&nbsp;", "<title>", "<script>", "</title>", "\n", "<pre>",
     "<a title='&quot;' id=q>", "</br>", "<!doctype html>", "<i", "</head>", "<textarea>", "&#10;", "<body class=b>"]
)


def random_documents(n, pieces=PIECES, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ranges_describe_a_proper_tree(spark):
    for row in parsed(spark, random_documents(400)):
        nodes, children, text = row.nodes, {}, bytes(row.doc_text)
        for at, n in enumerate(nodes):
            assert n.node_id == at and n.node_id <= n.last_desc < len(nodes)
            if n.parent_id >= 0:
                up = nodes[n.parent_id]
                assert up.depth == n.depth - 1 and n.parent_id < n.node_id and n.last_desc <= up.last_desc
                assert up.tag == n.parent_tag
                assert up.text_start <= n.text_start and n.text_start + n.text_len <= up.text_start + up.text_len
                assert up.piece_start <= n.piece_start and n.piece_start + n.piece_count <= up.piece_start + up.piece_count
                if n.kind == "element":
                    assert row.written[at] in row.written[n.parent_id]
            assert n.sib_pos == children.get(n.parent_id, 0)
            children[n.parent_id] = n.sib_pos + 1
            if n.kind == "element":
                assert row.written[at].startswith(f"<{n.tag}")
        assert b"".join(text[n.text_start : n.text_start + n.text_len] for n in nodes if n.kind == "text") == text


def test_canonical_markup_of_plain_trees_is_stable(spark):
    plain = ("<p>", "</p>", "<div class=x>", "</div>", "text ", "a &lt; b &amp; ", "<!--c-->")
    once = [whole(r) for r in parsed(spark, random_documents(200, plain))]
    assert [whole(r) for r in parsed(spark, once)] == once


def test_tokens_cover_the_document(spark):
    documents = random_documents(400, seed=7)
    frame = spark.createDataFrame([(d,) for d in documents], "html string").select(html_tokens.plain(F.col("html")).alias("m"))
    for r in frame.select("m", html_tokens.tokens(F.col("m")).alias("t"), html_tokens.fields(F.col("m")).alias("f")).collect():
        assert "".join(r.t) == r.m and r.f.count("\0") == 3 * len(r.t)


def test_references_equal_the_public_rules(spark):
    """The references of written markup, and those of the tree, against the library's table."""
    written = [f"&{n}" for n in list(html.entities.html5)[::7]] + ["&#65;", "&#x41", "&#150;", "&#xD800;", "&#1114112;", "&#9999999999;", "&ampx", "&nope;", "&", "&;"]
    names = html_tokens.with_names(lambda names: F.transform("t", lambda t: html_tokens.text(t, names)))
    got = spark.createDataFrame([([f"a{w} b" for w in written],)], "t array<string>").select(names).first()[0]
    assert got == [html.unescape(f"a{w} b") for w in written]


def test_long_tags_and_texts_are_linear(spark):
    """Doubling a tag with many attributes, an unclosed comment or a run of loose brackets doubles the time at most."""

    def seconds(n):
        documents = ["<a " + "x='1' " * n + ">t</a>", "<!-- " + "- " * n, "< " * n, "<p>" + "&amp;" * n, "<script>" + "</scrip" * n]
        start = time.perf_counter()
        rows = parse_html(spark.createDataFrame(list(enumerate(documents)), "k int, html string").coalesce(1)).select("k", F.size("nodes"))
        assert len(rows.collect()) == 5
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(40_000) for _ in range(2)), min(seconds(160_000) for _ in range(2))
    assert large < 6 * small + 1


def test_a_batch_is_nested_in_parts(spark):
    """A batch of many documents is spread out part by part; rows stay in order, whatever their sizes."""
    page, large = "<p>a<b>b</b></p>" * 20, "<i>c</i>" * 20_000
    documents = [large if i == 700 else None if i % 97 == 3 else "" if i % 89 == 5 else f"{page}<h1>{i}</h1>" for i in range(3000)]
    fields = spark.createDataFrame([(d,) for d in documents], "d string").coalesce(1).select(html_tokens.fields(F.col("d"))).toPandas()
    sizes = [len(trees) for trees in nodes.nested.func(iter([pa.array(fields.iloc[:, 0], pa.string()), pa.array([], pa.string())]))]
    assert sum(sizes) == 3000 and max(sizes) < 2500 and len(sizes) > 1
    rows = parse_html(spark.createDataFrame(list(enumerate(documents)), "k int, html string").coalesce(1)).select("k", "doc_text", F.size("nodes").alias("n"))
    for row in rows.collect():
        document = documents[row.k]
        assert row.doc_text == (None if document is None else bytearray(re.sub("<[^>]*>", "", document).encode()))
        assert row.n == (0 if document is None else 3 if document == "" else 3 + 40_000 if row.k == 700 else 3 + 80 + 2)
