"""Cleaned pages, plain text, kinds of link lists, samples and result pages of searches, made of one parsed page."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urljoin, urlsplit

from gleanspark.html.dom import Node, parse, shared, squeeze
from gleanspark.html.ops import body_of
from gleanspark.html.select import select

# Where main content is looked for, in this order, and how much text it needs.
MAIN_SELECTORS = [
    "main", "article", "#main-content", ".main-content", ".article-content", ".post-content", ".entry-content", "[role=main]", "#content", ".content",
    ".post", ".article", ".entry", ".doc", ".document", ".documentation", "#document-content", ".page-content", ".body-content", "body", ".body",
]
LEAST_TEXT, ENOUGH_TEXT, HEADING_WORTH = 300, 500, 1000
# What is taken out. Parts of class names and ids, of sources of frames and images, whole class names and ids, parts of styles.
CLASS_PARTS = ["ad-", "ads-", "banner", "share", "social", "twitter", "facebook", "newsletter", "popup", "modal"]
ID_PARTS = ["google_ad", "banner", "advertisement", "modal", "popup"]
FRAME_PARTS, IMAGE_PARTS = ["doubleclick", "googlead", "facebook"], ["pixel"]
CLASSES = {"comments", "comment-section", "disqus", "hidden", "hide", "invisible", "visually-hidden", "sr-only"}
IDS = {"comments", "disqus_thread"}
HIDING = ["display: none", "display:none", "visibility: hidden", "visibility:hidden"]
NOISE = {"script", "style", "svg", "noscript", "iframe", "link", "meta"}
SAMPLE, LABELS, LABEL = 40000, 40, 100
UNSAFE_SCHEMES = ("javascript:", "data:", "vbscript:", "file:", "about:")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _headings(nodes: list[Node]) -> int:
    return sum(n.tag in HEADINGS for top in nodes for n in top.walk())


def _length(nodes: list[Node]) -> int:
    return len("".join(n.text() for n in nodes).strip())


def main_by_selectors(root: Node) -> list[Node]:
    """What the first selector names whose matches have enough text and a heading; else the first with still more text."""
    spare: list[Node] = []
    for s in MAIN_SELECTORS:
        found = select(root, s)
        size = _length(found)
        if size > LEAST_TEXT and _headings(found):
            return found
        if size > ENOUGH_TEXT and not spare:
            spare = found
    return spare


def main_by_density(root: Node) -> list[Node]:
    """The block with the most text, a heading counting as much as many characters; the first of equals."""
    rated = [(_length([n]), _headings([n]), n) for n in root.walk() if n.tag in ("div", "section", "article")]
    rated = [(size + HEADING_WORTH * h, n) for size, h, n in rated if size > LEAST_TEXT or h]
    return [max(rated, key=lambda r: r[0])[1]] if rated else []


def main_by_headings(root: Node) -> list[Node]:
    """Each top heading with its siblings up to the next one, in a container of its own."""
    tops = [n for n in root.walk() if n.tag in ("h1", "h2")]
    if not tops:
        return []
    box = Node("div", {"class": "constructed-content"})
    for k, h in enumerate(tops):
        after = h.parent.children[next(i for i, c in enumerate(h.parent.children) if c is h) + 1 :]
        stop = tops[k + 1] if k + 1 < len(tops) else None
        box.children.append(h)
        for c in after:
            if c is stop or stop is None and isinstance(c, Node) and c.tag in ("h1", "h2"):
                break
            if isinstance(c, Node):
                box.children.append(c)
    return [box]


def _unwanted(n: Node) -> bool:
    cls, own, src = n.attrs.get("class", ""), n.attrs.get("id", ""), n.attrs.get("src", "")
    return (
        n.tag in ("script", "style")
        or any(x in cls for x in CLASS_PARTS)
        or any(x in own for x in ID_PARTS)
        or n.tag == "iframe" and any(x in src for x in FRAME_PARTS)
        or n.tag == "img" and any(x in src for x in IMAGE_PARTS)
        or not CLASSES.isdisjoint(n.classes())
        or own in IDS
        or any(x in n.attrs.get("style", "") for x in HIDING)
    )


def clean_html(text: str | None) -> str:
    """The main content within a wrapper, else the whole document; without ads, trackers, sharing, comments, pop-ups and what is hidden.

    Main content is found before anything is taken out: by selectors, then by density, then from headings, each only
    where the one before shows no heading. '' for null and empty pages.
    """
    if not text:
        return ""
    root = parse(text)
    main = main_by_selectors(root)
    if not _headings(main):
        main = main_by_density(root) or main
    if not _headings(main):
        main = main_by_headings(root) or main
    _strip(root)
    for n in main:
        _strip(n)
    if not main:
        return root.outer()
    return f'<div class="main-content-wrapper">{"".join(n.outer() for n in main)}</div>'


def _strip(top: Node) -> None:
    """Take out unwanted elements below and attributes that call or track."""
    stack = [top]
    while stack:
        n = stack.pop()
        n.attrs = {k: v for k, v in n.attrs.items() if not (k.startswith("on") or "track" in k or "analytics" in k)}
        n.children = [c for c in n.children if isinstance(c, str) or not _unwanted(c)]
        stack.extend(n.elements())


def text_only(text: str | None) -> str:
    """All text of the body, trimmed at both ends only."""
    if not text:
        return ""
    root = parse(text)
    for n in list(root.walk()):
        if n.tag in ("script", "style"):
            n.remove()
    return body_of(root).text().strip()


def legacy_links(text: str | None, url: str | None) -> list[str]:
    """Links as they stand once absolute: fragments and other schemes stay, first seen first."""
    out: dict[str, None] = {}
    for n in shared(text).walk() if text else ():
        if n.tag == "a" and n.attrs.get("href"):
            try:
                out[urljoin(url or "", n.attrs["href"].strip())] = None
            except ValueError:
                continue
    return list(out)


def visible_links(text: str | None, url: str | None) -> list[str]:
    """Legacy links without those that run or hold data."""
    return [x for x in legacy_links(text, url) if not x.lower().startswith(UNSAFE_SCHEMES)]


def labelled_links(text: str | None, url: str | None) -> list[dict]:
    """The first links with a text of their own, each address once."""
    out: dict[str, str] = {}
    for n in shared(text).walk() if text else ():
        if len(out) == LABELS:
            break
        if n.tag == "a" and "href" in n.attrs:
            try:
                at = urljoin(url or "", n.attrs["href"].strip())
            except ValueError:
                continue
            label = squeeze(n.text())[:LABEL]
            if label and at not in out and re.match("https?://", at, re.IGNORECASE):
                out[at] = label
    return [{"text": t, "url": u} for u, t in out.items()]


def sample(text: str | None) -> str:
    """The inside of the body without noise, cut to a size that a model can read."""
    if not text:
        return ""
    root = parse(text)
    for n in list(root.walk()):
        if n.tag in NOISE:
            n.remove()
    return (body_of(root).inner() or text)[:SAMPLE]


def _target(href: str) -> str | None:
    """Where a result leads: the address its redirect names, itself if it leads elsewhere, none for ads."""
    home = "duckduckgo.com"
    try:
        at = urlsplit(urljoin(f"https://{home}", href.strip())) if href.strip() else None
    except ValueError:
        return None
    if at is None:
        return None
    if named := parse_qs(at.query).get("uddg"):
        return named[0]
    host = (at.hostname or "").lower()
    return None if host == home or host.endswith(f".{home}") else at.geturl()


def search_results(text: str | None, limit: int) -> list[dict]:
    """Title, address, snippet and position of a result page's anchors, each address once, in order, at most limit."""
    out: dict[str, dict] = {}
    for a in shared(text).walk() if text and limit > 0 else ():
        if a.tag != "a" or "result__a" not in a.classes() or len(out) >= limit:
            continue
        url = _target(a.attrs.get("href", ""))
        if url and url not in out:
            up, note = a.parent, ""
            while up is not None and not note and up.tag != "body":
                note = next((n.text().strip() for n in up.walk() if "result__snippet" in n.classes()), "")
                if not {"result", "web-result", "results_links", "results_links_deep", "links_main", "result__body"}.isdisjoint(up.classes()):
                    break
                up = up.parent
            out[url] = {"title": a.text().strip(), "url": url, "snippet": note, "position": len(out) + 1}
    return list(out.values())
