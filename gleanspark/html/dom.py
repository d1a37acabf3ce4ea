"""A small tree of HTML elements on the standard library's parser, with the repairs of HTML5 that matter for text."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element that opens closes open ones of these kinds, up to an element of the second kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "a": ({"a"}, {"td", "th", "table"}),
}
IN_HEAD = frozenset("title meta link style script base noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the document."""
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.elements()[::-1])

    def text(self) -> str:
        out, stack = [], list(self.children[::-1])
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag != "#comment":
                stack.extend(c.children[::-1])
        return "".join(out)

    def inner(self) -> str:
        return "".join(_write(c, self.tag) for c in self.children)

    def outer(self) -> str:
        return _write(self, "")

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def closest(self, tag: str) -> Node | None:
        n: Node | None = self
        while n is not None and n.tag != tag:
            n = n.parent
        return n

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def _write(c: Node | str, parent: str) -> str:
    if isinstance(c, str):
        return c if parent in ("script", "style") else c.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
    attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in c.attrs.items())
    if c.tag == "#root":
        return c.inner()
    if c.tag in VOID:
        return f"<{c.tag}{attrs}>"
    return f"<{c.tag}{attrs}>{c.inner()}</{c.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.head = self.body = None
        self.open: list[Node] = [self.root]

    def _page(self) -> None:
        if self.html is None:
            self.html = Node("html", parent=self.root)
            self.root.children.append(self.html)
        if self.head is None:
            self.head = Node("head", parent=self.html)
            self.html.children.append(self.head)

    def _in_body(self) -> None:
        self._page()
        if self.body is None:
            self.body = Node("body", parent=self.html)
            self.html.children.append(self.body)
            self.open = [self.root, self.html, self.body]

    def handle_starttag(self, tag, attrs):
        held = {k: v if v is not None else "" for k, v in reversed(attrs)}
        held = {k: held[k] for k, _ in attrs}
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._in_body()
            else:
                self._page()
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            node.attrs = held | node.attrs
            if tag == "head" and self.body is None:
                self.open = [self.root, self.html, self.head]
            return
        if self.body is None:
            self._page()
            if tag in IN_HEAD:
                if self.open[-1] is self.root or self.open[-1] is self.html:
                    self.open = [self.root, self.html, self.head]
            else:
                self._in_body()
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "table", "button", "body"} | (ENDS_P - {"p"}))
        if tag in CLOSES:
            kinds, stop = CLOSES[tag]
            self._close(kinds, stop, many=tag not in ("a",))
        if tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        self._push(tag, held)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        n = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(n)
        self.open.append(n)

    def _close(self, kinds: set[str], stop: set[str], many: bool = True) -> None:
        k, low = len(self.open) - 1, 0
        while k > 0 and self.open[k].tag not in stop:
            if self.open[k].tag in kinds:
                low = k
                if not many:
                    break
            k -= 1
        if low:
            del self.open[low:]

    def handle_endtag(self, tag):
        if tag in ("html", "body", "head"):
            if tag == "head" and self.body is None and self.html is not None:
                self.open = [self.root, self.html]
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k] is self.body:
                break
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def handle_data(self, data):
        if self.open[-1].tag not in IN_HEAD and self.body is None:
            if not data.strip():
                return
            self._in_body()
        if self.open[-1].tag in ("#root", "html", "head"):
            if not data.strip():
                return
            self._in_body()
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(text: str) -> Node:
    """The tree of a document; html, head and body are always there. Never fails on what is odd."""
    b = _Builder()
    b.feed(text)
    b.close()
    b._in_body()
    return b.root


@functools.lru_cache(1)
def shared(text: str) -> Node:
    """The tree of a document for those who only read it; outputs of the same page have it in common."""
    return parse(text)


def unescape(text: str) -> str:
    return html.unescape(text)


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
