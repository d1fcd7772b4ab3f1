"""Whole results over pages: malformed markup against a walk over the same trees spelled out."""

from html.parser import HTMLParser

import pytest

import __spark_entry__ as contract

HEADERS = {"h1", "h2", "h3", "h4", "h5", "h6", "font", "div", "span", "a"}
#: Markup, and its tree by the public parsing rules with every tag written.
PAGES = [
    ("<title>t</title><h1>a</h1><h1>b<span>c</span></h1>",
     "<html><head><title>t</title></head><body><h1>a</h1><h1>b<span>c</span></h1></body></html>"),
    ("<p><b>x<p>y<strong>z</strong>",
     "<html><head></head><body><p><b>x</b></p><p><b>y<strong>z</strong></b></p></body></html>"),
    ("<div><strong>q</strong><div><b>r<i>s</i></b></div></div><li><b>no</b>",
     "<html><head></head><body><div><strong>q</strong><div><b>r<i>s</i></b></div></div><li><b>no</b></li></body></html>"),
    ("<!-- c --><table><tr><td><a href=1>l<td><font>f</table>",
     "<html><head></head><body><table><tbody><tr><td><a>l</a></td><td><font>f</font></td></tr></tbody></table></body></html>"),
    ("", "<html><head></head><body></body></html>"),
]


class Walk(HTMLParser):
    """Elements in document order: tag, parent, depth, text."""

    def __init__(self, markup):
        super().__init__()
        self.open, self.found = [], []
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, self.open[-1] if self.open else None, len(self.open), ""])
        self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for at in self.open:
            self.found[at][3] += data


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, f"u{i}", markup) for i, (markup, _) in enumerate(PAGES)] + [(99, "none", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    return lambda name: sorted(contract.queries()[name](spark, place).collect(), key=lambda r: (r.page_id, r.node_id))


def candidates(elements):
    for tag, parent, _, text in elements:
        if tag in HEADERS or tag in ("b", "strong") and elements[parent][0] in ("p", "div"):
            yield tag, text


def test_every_element_is_returned(pages):
    got, want = pages("H1_html_nodes_pages"), []
    for i, (_, spelled) in enumerate(PAGES):
        elements, base = Walk(spelled).found, min((r.depth for r in got if r.page_id == i), default=0)
        ids = [r.node_id for r in got if r.page_id == i]
        want += [(i, e[0], None if e[1] is None else ids[e[1]], e[2] + base) for e in elements]
    roots = {(r.page_id, r.node_id) for r in got if r.tag == "html"}
    assert [(r.page_id, r.tag, None if (r.page_id, r.node_id) in roots else r.parent_id, r.depth) for r in got] == want
    assert [r.tag for r in got if r.page_id == 3 and r.implied] == ["html", "head", "body", "tbody"]


def test_every_candidate_and_its_text_are_returned(pages):
    want = [(i, *c) for i, (_, spelled) in enumerate(PAGES) for c in candidates(Walk(spelled).found)]
    texts = pages("H3_element_text_pages")
    assert [(r.page_id, r.tag, r.text) for r in texts] == want
    assert [tuple(r) for r in pages("H2_header_candidates_pages")] == [(r.page_id, r.node_id, r.tag) for r in texts]
