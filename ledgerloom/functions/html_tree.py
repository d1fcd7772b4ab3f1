"""The nesting step: marks of tokens in, a tree in preorder out.

Tokens are cut and written by Spark expressions (``html_tokens``); this helper decides which element holds which.  It follows the public parsing
rules that change the shape of real filings: implied html/head/body/tbody/tr, block starts closing an open ``p``, list
items closing each other, formatting elements reopened in the next block, mis-nested formatting end tags, and content
misplaced directly inside a table moved in front of it.  Not covered: foreign content, frames, templates and the special
rules of form controls.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

from . import html_rules as rules

RAW = {*rules.RAW_TEXT, *rules.ESCAPABLE_RAW_TEXT}
LEGACY_DOCTYPE = re.compile(rules.LEGACY_DOCTYPE)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.ASCII)
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def attributes(inside: str) -> dict[str, str]:
    """The attributes of a tag; of equal names the first counts.  A reference without semicolon must be a known name."""

    def decode(m: re.Match) -> str:
        bare = m[1][0] != "#" and not m[1].endswith(";")
        return m[0] if bare and (m[2] or m[1] not in html5) else unescape("&" + m[1]) + m[2]

    values = ((n.lower(), a or b or c) for n, a, b, c in reversed(ATTRIBUTE.findall(inside)))
    return {n: REFERENCE.sub(decode, v) if "&" in v else v for n, v in values}


class Node:
    __slots__ = ("children", "implied", "parent", "slot", "tag", "token")

    def __init__(self, tag, token=-1, implied=False):
        self.tag, self.token, self.implied = tag, token, implied  # of a text: its tokens
        self.parent, self.children, self.slot = None, [], 0

    def place_of(self, child):
        """Index of a child; the last known one is tried first, so that no insertion searches all siblings."""
        if not (child.slot < len(self.children) and self.children[child.slot] is child):
            child.slot = next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is child)
        return child.slot

    def add(self, child, before=None):
        if child.parent is not None:
            del child.parent.children[child.parent.place_of(child)]
        child.parent, child.slot = self, len(self.children) if before is None else self.place_of(before)
        self.children.insert(child.slot, child)
        if before is not None:
            before.slot = child.slot + 1


class Nesting:
    """The open elements of one document, and what each mark does to them."""

    def __init__(self, insides):
        self.root, self.stack, self.formatting = Node("#document"), [], []  # None in the last marks a cell's border
        self.head = self.body = None
        self.after_body, self.skip_newline, self.quirks, self.insides = False, False, True, insides

    def in_scope(self, tags, edge=rules.SCOPE_EDGE):
        return next((n.tag in tags for n in reversed(self.stack) if n.tag in tags or n.tag in edge), False)

    def pop_until(self, tags, inclusive=True):
        while inclusive or self.stack[-1].tag not in tags:
            tag = self.stack.pop().tag
            while tag in rules.CELLS and self.formatting and self.formatting.pop() is not None:
                pass
            if tag in tags:
                return

    def close_p(self):
        if self.in_scope({"p"}, rules.BUTTON_EDGE):
            self.pop_until({"p"})

    def place(self, node, foster=True):
        """Append to the current node; content loose in a table goes in front of the table instead."""
        target, at, table = self.stack[-1], None, None
        if foster and target.tag in rules.TABLE_SHELL:
            table = next((n for n in reversed(self.stack) if n.tag == "table" and n.parent is not None), None)
        if table is not None:
            target, at = table.parent, table.parent.place_of(table)
        last = target.children[at - 1 if at is not None else -1] if at or (at is None and target.children) else None
        if node.tag == "#text" and last is not None and last.tag == "#text":
            last.token += node.token
        elif table is not None:
            target.add(node, table)
        else:
            node.parent = target
            target.children.append(node)

    def open(self, tag, token=-1, implied=False, foster=True):
        node = Node(tag, token, implied)
        if self.stack:
            self.place(node, foster)
        else:
            self.root.add(node)
        if tag not in rules.VOID:
            self.stack.append(node)
        return node

    def skeleton(self, upto, token=-1, implied=True):
        """Make sure that html, head and body exist as far as ``upto``."""
        if not self.stack:
            self.open("html", token if upto == "html" else -1, implied or upto != "html")
        if upto != "html" and self.head is None:
            self.head = self.open("head", token if upto == "head" else -1, implied or upto != "head")
        if upto == "body" and self.body is None:
            del self.stack[1:]
            self.body = self.open("body", token, implied)

    # --- formatting elements -------------------------------------------------------------------
    def reopen_formatting(self):
        entries, at = self.formatting, len(self.formatting)
        if at and entries[-1] is self.stack[-1]:
            return
        while at and entries[at - 1] is not None and entries[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(entries)):
            entries[i] = self.open(entries[i].tag, entries[i].token, implied=True)

    def open_entries(self, tag):
        """Remembered formatting of a tag since the last cell border, latest first."""
        for entry in reversed(self.formatting):
            if entry is None:
                return
            if entry.tag == tag:
                yield entry

    def remember(self, node):
        own = self.insides[node.token]
        same = lambda e: self.insides[e.token] == own or attributes(self.insides[e.token]) == attributes(own)
        twins = [e for e in self.open_entries(node.tag) if same(e)]
        if len(twins) >= 3:
            self.formatting.remove(twins[-1])
        self.formatting.append(node)

    def close_formatting(self, tag):
        """End tag of a formatting element, also where a block was opened in between."""
        for _ in range(8):
            entry = next(self.open_entries(tag), None)
            if entry is None:
                return self.close_inline(tag)
            if entry not in self.stack:
                return self.formatting.remove(entry)
            at = self.stack.index(entry)
            above = [node.tag for node in self.stack[at + 1 :]]
            if any(t in rules.SCOPE_EDGE for t in above):
                return None
            block = next((i for i, t in enumerate(above, at + 1) if t in rules.SPECIAL), None)
            if block is None:
                del self.stack[at:]
                return self.formatting.remove(entry)
            self.split_around(entry, at, block)

    def split_around(self, entry, at, block_at):
        """Move the block out of the formatting element and give its content a copy of it."""
        block, holder, formatting = self.stack[block_at], self.stack[at - 1], self.formatting
        last, mark = block, formatting.index(entry)
        for depth, node in enumerate(reversed(self.stack[at + 1 : block_at]), 1):
            if node in formatting and depth > 3:
                mark -= formatting.index(node) < mark
                formatting.remove(node)
            if node not in formatting:
                self.stack.remove(node)
                continue
            copy, place = Node(node.tag, node.token, True), formatting.index(node)
            mark = place + 1 if last is block else mark
            formatting[place] = self.stack[self.stack.index(node)] = copy
            copy.add(last)
            last = copy
        table = holder.tag in rules.TABLE_SHELL and next((n for n in reversed(self.stack[:at]) if n.tag == "table"), None)
        (table.parent if table and table.parent else holder).add(last, table if table and table.parent else None)
        copy, place = Node(entry.tag, entry.token, True), formatting.index(entry)
        copy.children, block.children = block.children, []
        for child in copy.children:
            child.parent = copy
        block.add(copy)
        formatting.remove(entry)
        formatting.insert(mark - (place < mark), copy)
        self.stack.remove(entry)
        self.stack.insert(self.stack.index(block) + 1, copy)

    def close_inline(self, tag):
        for node in reversed(self.stack):
            if node.tag == tag:
                del self.stack[self.stack.index(node) :]
            if node.tag == tag or node.tag in rules.SPECIAL:
                return

    # --- tokens --------------------------------------------------------------------------------
    def text(self, blank, word):
        """White space, or a text behind white space; each is a list of one token or none."""
        self.skip_newline = False
        self.after_body = self.after_body and not word
        if self.body is None and word:
            if self.head is not None and blank:
                self.place(Node("#text", blank))
            self.skeleton("body")
            blank = []
        if self.body is None and self.head is None:
            return
        if self.body is not None and (word or self.stack[-1].tag not in rules.TABLE_SHELL):
            self.reopen_formatting()
        if blank or word:
            self.place(Node("#text", blank + word), foster=bool(word))

    def comment(self, token):
        if not self.stack or self.after_body:
            (self.stack[0] if self.stack else self.root).add(Node("#comment", token))
        else:
            self.place(Node("#comment", token), foster=False)

    def start(self, tag, token):
        self.skip_newline = self.after_body = False
        if tag in ("html", "head", "body"):
            return self.skeleton(tag, token, implied=False)
        if self.body is None and tag in rules.HEAD_ONLY:
            self.skeleton("head")
            if self.stack[-1] is self.head:
                return self.open(tag, token)
            self.head.add(late := Node(tag, token))  # after </head>: still part of the head
            self.stack += [] if tag in rules.VOID else [late]
            return None
        if self.body is None:
            self.skeleton("body")
        if tag in rules.TABLE_HOLDERS:
            return self.start_table_part(tag, token) if self.in_scope({"table"}, {"html", "template"}) else None
        if tag in rules.CLOSES_P:
            if tag in rules.LIST_ITEMS:
                self.close_item(rules.LIST_ITEMS[tag])
            self.close_p()
            if tag in rules.HEADINGS and self.stack[-1].tag in rules.HEADINGS:
                self.stack.pop()
            self.skip_newline = tag in ("pre", "listing")
        elif tag == "table":
            if self.stack[-1].tag in rules.TABLE_SHELL:
                self.pop_until({"table"})
            if not self.quirks:
                self.close_p()
        elif tag not in rules.HEAD_ONLY:
            if tag == "option" and self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "a" and (entry := next(self.open_entries("a"), None)) is not None:
                self.close_formatting("a")
                for where in (self.formatting, self.stack):
                    if entry in where:
                        where.remove(entry)
            self.reopen_formatting()
            self.skip_newline = tag == "textarea"
        node = self.open(tag, token)
        if tag in rules.FORMATTING:
            self.remember(node)
        return None

    def start_table_part(self, tag, token):
        self.pop_until(rules.TABLE_HOLDERS[tag], inclusive=False)
        if tag in ("td", "th", "tr") and self.stack[-1].tag == "table":
            self.open("tbody", implied=True, foster=False)
        if tag in ("td", "th") and self.stack[-1].tag in rules.SECTIONS:
            self.open("tr", implied=True, foster=False)
        if tag == "col" and self.stack[-1].tag == "table":
            self.open("colgroup", implied=True, foster=False)
        self.open(tag, token, foster=False)
        if tag in rules.CELLS:
            self.formatting.append(None)

    def close_item(self, tags):
        for node in reversed(self.stack):
            if node.tag in tags:
                return self.pop_until({node.tag})
            if node.tag in rules.SPECIAL and node.tag not in ("address", "div", "p"):
                return None

    def end(self, tag):
        self.skip_newline = False
        if tag == "head":
            if self.head in self.stack:
                del self.stack[1:]
        elif tag in ("body", "html"):
            self.skeleton("body")
            self.after_body = True
        elif self.body is None and tag not in ("br", "p"):
            pass
        elif tag in rules.TABLE_HOLDERS or tag == "table":
            if self.in_scope({tag}, rules.TABLE_EDGE):
                self.pop_until({tag})
        elif tag in rules.FORMATTING:
            self.close_formatting(tag)
        elif tag in ("br", "p"):
            self.skeleton("body")
            if tag == "br" or not self.in_scope({"p"}, rules.BUTTON_EDGE):
                self.open(tag, implied=True)
            if tag == "p":
                self.pop_until({"p"})
        elif tag in rules.CLOSES_P:
            names = rules.HEADINGS if tag in rules.HEADINGS else {tag}
            if self.in_scope(names, rules.LIST_EDGE if tag == "li" else rules.SCOPE_EDGE):
                self.pop_until(names)
        else:
            self.close_inline(tag)


def operation(mark: str) -> tuple[str, str]:
    """What a mark asks for, and of which element."""
    name = mark.lstrip("</").lower()
    if not mark:
        return "text", ""
    if mark[0] != "<":
        return ("break" if unescape(mark) == "\n" else "blank"), ""
    if mark[1].isalpha():
        return ("raw" if name in RAW else "start"), name
    if mark[:2] == "</":
        return ("end" if name[:1].isalpha() else "nothing" if mark == "</>" else "comment"), name
    return ("doctype", mark[9:].strip()) if mark[:9].lower() == "<!doctype" else ("comment", "")


def nest(operations: list[tuple[str, str]], texts: list[str], insides: list[str]) -> Node:
    """The document node.  A text node's tokens are twice their number, plus one where a first line break is dropped."""
    build, blank = Nesting(insides), []
    for token, (kind, tag) in enumerate(operations):
        if kind == "text":
            if texts[token]:
                build.text(blank, [2 * token])
                blank = []
            continue
        if blank:
            build.text(blank, [])
            blank = []
        if kind == "start":
            build.start(tag, token)
        elif kind == "end":
            build.end(tag)
        elif kind in ("blank", "break"):
            dropped = build.skip_newline and kind == "break"
            blank = [2 * token + dropped] if len(texts[token]) > dropped else []
            build.skip_newline = build.skip_newline and not dropped
        elif kind == "raw":  # an element and its whole content
            build.start(tag, token)
            if texts[token]:
                build.place(Node("#text", [2 * token]))
            build.stack.pop()
            build.skip_newline = False
        elif kind == "comment":
            build.comment(token)
        elif kind == "doctype":
            build.quirks = bool(LEGACY_DOCTYPE.search(tag))
    if blank:
        build.text(blank, [])
    build.skeleton("body")
    return build.root
