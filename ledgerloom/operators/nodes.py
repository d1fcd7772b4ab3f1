"""Documents -> HTML nodes.

``parse_html`` is a narrow step: no shuffle, one output row per document, all other columns carried
along.  A Spark expression cuts the markup into tokens (``functions.html_tokens``), and one Arrow
function nests them.
A document's nodes stay together in one array, in preorder, so that the section search is a set of
array expressions in the same stage instead of self-joins of a node table.  Node texts are byte ranges
of one ``doc_text``; node markup is a range of pieces of ``doc_html``, written only where it is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html_tokens
from ..functions.html_rules import RAW_TEXT, UNESCAPED_OUTPUT, VOID
from ..functions.html_tree import Node, attributes, nest, operation
from ..functions.text import byte_slice

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("parent_tag", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib_pos", T.IntegerType()),
        T.StructField("last_desc", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attr_id", T.StringType()),
        T.StructField("attr_class", T.StringType()),
        T.StructField("has_href", T.BooleanType()),
        T.StructField("text_start", T.IntegerType()),
        T.StructField("text_len", T.IntegerType()),
        T.StructField("piece_start", T.IntegerType()),
        T.StructField("piece_count", T.IntegerType()),
        T.StructField("implied", T.BooleanType()),
    ]
)
TREE = T.StructType(
    [
        T.StructField("text", T.BinaryType()),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)
PARSED = ["doc_text", "doc_html", "nodes"]

# Tags that may carry a section header.
HEADER_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "font", "div", "span", "a"]
BOLD_TAGS = ["b", "strong"]
BOLD_PARENTS = ["p", "div"]


ASKED = re.compile(r"(?i)(?:^|[\s/\"'])(?:id|class|href)(?=[\s/=]|$)")
NO_ATTRIBUTES: dict[str, str] = {}


def _preorder(root: Node, insides: list[str], rows: list[list], texts: list[int], pieces: list[int], names: dict[str, int]) -> None:
    """Append a document's nodes, the order of its texts, and the order of the pieces of its markup.

    A piece is a token's number times four for its tag or comment; for its text as it is one more, escaped two, and
    escaped without its first line break three.  A tag that no token wrote is ``-1 - 2 * name``, an end tag one less.
    """
    open_elements = [(enumerate(root.children), -1, -1, False)]
    base, text_base, piece_base = len(rows), len(texts), len(pieces)
    while open_elements:
        children, parent_id, parent_name, plain = open_elements[-1]
        for pos, node in children:
            tag, node_id = node.tag, len(rows) - base
            name = names.setdefault(tag, len(names))
            row = [node_id, parent_id, parent_name, len(open_elements) - 1, pos, node_id, name, NO_ATTRIBUTES,
                   len(texts) - text_base, 0, len(pieces) - piece_base, 1, node.implied]
            rows.append(row)
            if tag == "#text":
                texts += node.token
                row[9] = row[11] = len(node.token)
                pieces += [4 * (t >> 1) + (1 if plain else 2 + (t & 1)) for t in node.token]
            elif tag == "#comment":
                pieces.append(4 * node.token)
            else:
                if node.token >= 0 and insides[node.token] and ASKED.search(insides[node.token]):
                    row[7] = attributes(insides[node.token])
                pieces.append(4 * node.token if node.token >= 0 else -1 - 2 * name)
                if tag not in VOID:
                    open_elements.append((enumerate(node.children), node_id, name, tag in UNESCAPED_OUTPUT))
                    break
        else:
            open_elements.pop()
            if parent_id >= 0:
                pieces.append(-2 - 2 * parent_name)
                row = rows[base + parent_id]
                row[5], row[9] = len(rows) - base - 1, len(texts) - text_base - row[8]
                row[11] = len(pieces) - piece_base - row[10]


def _document(fields: str, rows: list[list], pieces: list[int], names: dict[str, int], known: dict[str, tuple[str, str]]) -> bytes:
    """Nest one document, append its nodes and pieces, and return its text.  Places of texts become bytes."""
    parts = fields.split("\0")
    marks, texts, insides = parts[:-1:3], parts[1::3], parts[2::3]
    for mark in set(marks).difference(known):
        known[mark] = operation(mark)
    operations = [known[m] for m in marks]
    for i, read in enumerate(texts):
        if "&" in read and operations[i][1] not in RAW_TEXT:
            texts[i] = unescape(read)
            if not marks[i] and not texts[i].strip("\t\n\f\r "):  # references to nothing but white space
                operations[i] = operation(texts[i][:1])
        if read[:1] == "\n" and operations[i][1] == "textarea":
            texts[i] = texts[i][1:]
    order: list[int] = []
    first = len(rows)
    _preorder(nest(operations, texts, insides), insides, rows, order, pieces, names)
    written = [texts[t >> 1][t & 1 :].encode("utf-8", "replace") for t in order]
    at = np.concatenate([[0], np.cumsum([len(w) for w in written], dtype=np.int64)]).tolist()
    for row in rows[first:]:
        row[9] = at[row[8] + row[9]] - at[row[8]]
        row[8] = at[row[8]]
    return b"".join(written)


#: Bytes of token fields nested at a time.  The rows of a tree take many times its markup as Python objects, and a batch may
#: hold thousands of documents, so only one part of a batch is ever spread out.
PART = 1 << 20


def _parts(fields: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring documents of about ``PART`` bytes together; what begins behind that is the next part's."""
    sizes = pc.fill_null(pc.binary_length(fields), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PART
    starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(fields)]
    return (fields.slice(start, end - start) for start, end in zip(starts, starts[1:]))


@F.arrow_udf(TREE)
def nested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tree of each document's tokens, its text, and the order of the pieces of its markup."""
    for fields in batches:
        for part in _parts(fields):
            yield _trees(part)


def _trees(fields: pa.Array) -> pa.Array:
    texts, rows, pieces, names = [], [], [], []
    limits: list[list[int]] = [[0], [0], [0]]
    known: dict[str, tuple[str, str]] = {}
    for document in fields.to_pylist():
        own: dict[str, int] = {}
        texts.append(None if document is None else _document(document, rows, pieces, own, known))
        names += own
        for limit, values in zip(limits, (rows, pieces, names)):
            limit.append(len(values))
    columns = list(zip(*rows)) or [()] * 13
    node_id, parent_id, parent_name, depth, sib_pos, last_desc, name, found, text_start, text_len, piece_start, piece_count, implied = columns
    every_name, before = pa.array(names, pa.string()), np.repeat(limits[2][:-1], np.diff(limits[0]))

    def named(codes: tuple) -> pa.Array:
        at = np.array(codes, np.int64)
        return every_name.take(pa.array(at + before, mask=at < 0))

    def ints(values: tuple) -> pa.Array:
        return pa.array(values, pa.int32())

    tags = named(name)
    loose = pc.starts_with(tags, "#")
    values = [
        ints(node_id), ints(parent_id), named(parent_name), ints(depth), ints(sib_pos), ints(last_desc),
        pc.if_else(loose, pc.utf8_ltrim(tags, "#"), "element"), pc.if_else(loose, pa.scalar(None, pa.string()), tags),
        pa.array([a.get("id") for a in found], pa.string()), pa.array([a.get("class") for a in found], pa.string()),
        pa.array(["href" in a for a in found], pa.bool_()), ints(text_start), ints(text_len), ints(piece_start),
        ints(piece_count), pa.array(implied, pa.bool_()),
    ]
    trees = [pa.StructArray.from_arrays(values, names=NODE.names), ints(pieces), every_name]
    lists = [pa.ListArray.from_arrays(pa.array(limit, pa.int32()), values) for values, limit in zip(trees, limits)]
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), *lists], names=TREE.names)


def parse_html(documents: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup column by ``doc_text``, ``doc_html`` and ``nodes``; every other column stays as it is.

    A null document yields no nodes.
    """
    kept = [c for c in documents.columns if c != html]
    markup = documents.select(*kept, html_tokens.plain(F.col(html)).alias("_markup"))
    # declared not deterministic, so that the optimizer never copies it to where its columns are read
    tree = markup.withColumn("_tree", nested.asNondeterministic()(html_tokens.fields(F.col("_markup"))))
    return tree.select(
        *kept,
        F.col("_tree.text").alias("doc_text"),
        F.struct(F.col("_markup").alias("markup"), "_tree.pieces", "_tree.names").alias("doc_html"),
        F.col("_tree.nodes").alias("nodes"),
    )


def html_nodes(parsed: DataFrame) -> DataFrame:
    """Node table: one row per node, with the columns of ``NODE``."""
    keys = [c for c in parsed.columns if c not in PARSED]
    return parsed.select(*keys, F.inline("nodes"))


def is_header(node: Column) -> Column:
    """May this element carry a section header?"""
    return node["tag"].isin(HEADER_TAGS) | (
        node["tag"].isin(BOLD_TAGS) & node["parent_tag"].isin(BOLD_PARENTS)
    )


def bound(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value taken out of its row once.

    Reading a BINARY column copies all of it.  Inside a lambda that would happen for every node, which
    is quadratic in the size of the document; as the variable of an outer lambda it is one copy.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def node_text(doc_text: Column, node: Column) -> Column:
    """All text below an element, script and style included."""
    return byte_slice(doc_text, node["text_start"], node["text_len"])


def markup_tokens(doc_html: Column) -> Column:
    """The tokens that ``node_html`` spells out."""
    return html_tokens.tokens(doc_html["markup"])


def node_html(doc_html: Column, tokens: Column, node: Column, before: Column | None = None) -> Column:
    """Canonical markup of an element; ``tokens`` are those of ``doc_html``.  With ``before`` only what precedes that
    node: an element that holds it is left open."""

    def written(piece: Column, names: Column) -> Column:
        name = F.get(doc_html["names"], F.shiftright(-1 - piece, 1))
        tag = F.concat(F.when(piece.bitwiseAND(1) == 1, "<").otherwise("</"), name, F.lit(">"))
        token, kind = F.get(tokens, F.shiftright(piece, 2)), piece.bitwiseAND(3)
        text = html_tokens.escaped_text(token, names)
        loose = F.when(kind == 1, html_tokens.text(token, names)).when(kind == 2, text).otherwise(F.substring(text, F.lit(2), F.length(text)))
        return F.when(piece < 0, tag).when(kind == 0, html_tokens.written(token, names)).otherwise(loose)

    count = node["piece_count"]
    if before is not None:
        count = F.least(count, before["piece_start"] - node["piece_start"])
    own = F.slice(doc_html["pieces"], node["piece_start"] + 1, count)
    return html_tokens.with_names(lambda names: F.array_join(F.transform(own, lambda piece: written(piece, names)), ""))


def header_candidates(parsed: DataFrame) -> DataFrame:
    """Keep the nodes that may carry a header (still one row per document)."""
    return parsed.withColumn("candidates", F.filter("nodes", is_header))
