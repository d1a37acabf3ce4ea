"""CSS selectors: types, classes, ids, attributes, combinators, lists, :nth-child, :first-child, :last-child and :not."""

from __future__ import annotations

import functools
import re

from gleanspark.html.dom import Node

_PART = re.compile(r"""\s*([>+~,]|\s)\s*|(\*|[A-Za-z][\w-]*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child|nth-child|not)(?:\(([^()]*)\))?""")


class BadSelector(ValueError):
    """A selector that isn't understood."""


def _nth(arg: str):
    a = arg.strip().lower().replace(" ", "")
    a = {"odd": "2n+1", "even": "2n"}.get(a, a)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", a)
    if not m:
        raise BadSelector(arg)
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


@functools.lru_cache(512)
def compile_selector(text: str):
    """A list of chains; a chain is [(combinator, tests)...] from left to right."""
    chains, chain, tests, comb, at = [], [], [], " ", 0
    s = text.strip()
    if not s:
        raise BadSelector(text)

    def flush():
        nonlocal tests
        if not tests:
            raise BadSelector(text)
        chain.append((comb, tuple(tests)))
        tests = []

    while at < len(s):
        m = _PART.match(s, at)
        if not m or m.end() == at:
            raise BadSelector(text)
        at = m.end()
        if m[1] is not None:
            flush()
            c = m[1] if m[1] in ">+~," else " "
            if c == ",":
                chains.append(tuple(chain))
                chain, comb = [], " "
            else:
                comb = c
        elif m[2]:
            tests.append(("tag", m[2].lower()))
        elif m[3]:
            tests.append(("class", m[3]))
        elif m[4]:
            tests.append(("id", m[4]))
        elif m[5]:
            tests.append(("attr", m[5].lower(), m[6], next((x for x in (m[7], m[8], m[9]) if x is not None), "")))
        elif m[10] == "not":
            tests.append(("not", compile_selector(m[11] or "")))
        elif m[10] == "nth-child":
            tests.append(("nth", *_nth(m[11] or "")))
        else:
            tests.append((m[10],))
    flush()
    chains.append(tuple(chain))
    return tuple(chains)


def _test(n: Node, t) -> bool:
    kind = t[0]
    if kind == "tag":
        return t[1] == "*" or n.tag == t[1]
    if kind == "class":
        return t[1] in n.classes()
    if kind == "id":
        return n.attrs.get("id") == t[1]
    if kind == "attr":
        v = n.attrs.get(t[1])
        if v is None or t[2] is None:
            return v is not None
        x = t[3]
        return {"=": v == x, "~=": x in v.split(), "^=": x != "" and v.startswith(x), "$=": x != "" and v.endswith(x), "*=": x != "" and x in v, "|=": v == x or v.startswith(x + "-")}[t[2]]
    if kind == "not":
        return not any(_matches(n, c) for c in t[1])
    same = n.parent.elements() if n.parent else [n]
    place = next(k for k, x in enumerate(same) if x is n) + 1
    if kind == "first-child":
        return place == 1
    if kind == "last-child":
        return place == len(same)
    a, b = t[1], t[2]
    return place == b if a == 0 else (place - b) % abs(a) == 0 and (place - b) // a >= 0


def _matches(n: Node, chain) -> bool:
    comb, tests = chain[-1]
    if not all(_test(n, t) for t in tests):
        return False
    rest = chain[:-1]
    if not rest:
        return True
    if comb == ">":
        return n.parent is not None and _matches(n.parent, rest)
    if comb in "+~":
        same = n.parent.elements() if n.parent else []
        before = same[: next((k for k, x in enumerate(same) if x is n), 0)]
        return any(_matches(x, rest) for x in (before[-1:] if comb == "+" else before))
    p = n.parent
    while p is not None:
        if _matches(p, rest):
            return True
        p = p.parent
    return False


def select(base: Node, selector: str) -> list[Node]:
    """Elements below base that match, in the order of the document."""
    chains = compile_selector(selector)
    return [n for n in base.walk() if any(_matches(n, c) for c in chains)]
