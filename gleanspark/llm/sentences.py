"""Sentence units in many languages and scripts, by dynamic programming over whole sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values. Abbreviations behind which a sentence goes on, whatever follows.
GOES_ON = set(
    "mr mrs ms dr prof st vs cf approx no vol sec fig app ca ver jan feb mar apr jun jul aug sep sept oct nov dec p pp art ed eds "
    "hr fr nr gez vgl abschn bzw bd str "
    "mme mlle env av ex "
    "sr sra dra avda pág núm ej n v "
    "ул г тыс т стр см рис им "
    "κ δηλ δευτ σελ αρ "
    "د م "
    "डॉ श्री".split()
)
# Abbreviations that end a sentence if a capital follows, and not otherwise.
MAY_END = set("etc inc co ltd corp jr a.m p.m am pm pts usw al u.s e.u ph.d d.c κ.λπ κ.ά др пр h s min".split())
# Month names that follow an ordinal with a point.
ORDINAL_NEXT = set("januar februar märz april mai juni juli august september oktober november dezember jahrhundert auflage".split())
# Openings that tell a new sentence after an abbreviation that may end one.
OPENERS = set("the a an in at on its it he she we they this that there what when where why how who is each some few most since because prices roughly version everything anyone between neither half according".split())
SPEECH = "说|道|问|喊|答|叫"

PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", "《": "》", "【": "】"}
CLOSERS = set(PAIRS.values())
ENDS = ".!?…。！？؟।۔॥"
MARK = re.compile("[“”„«»「」『』（）()\\[\\]‘’《》【】\"']")
CAND = re.compile("[.!?…。！？؟।۔॥;;]+")
THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
LIST = re.compile(r"[^\S\n]*(?:[-*•‣◦–]|\(?\d{1,3}[.)]|\(?[a-z][)])[^\S\n]+(?=\S)")
HEAD = re.compile(r"[^\S\n]*#{1,6}(?:[^\S\n]|$)")
WORD_BEFORE = re.compile(r"[^\W_](?:[^\s()\[\]«»“”„\"'‘’,;:!?—–/]*[^\W_])?$|डॉ$")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
KANA = re.compile(r"[぀-ヿ]")
SPACE = re.compile(r"\s+")
#: Spans reach back over so many candidates at least, and further as long as a quotation is open.
REACH = 48


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, heading): stretches that headings, list items and blank lines part for certain."""
    out, begin, pos, kind = [], None, 0, False
    for line in text.split("\n"):
        end = pos + len(line)
        if not line.strip():
            if begin is not None:
                out.append((begin, pos, kind))
            begin = None
        elif HEAD.match(line):
            if begin is not None:
                out.append((begin, pos, kind))
            out.append((pos, end, True))
            begin = None
        elif LIST.match(line):
            if begin is not None:
                out.append((begin, pos, kind))
            begin, kind = pos, False
        elif begin is None:
            begin, kind = pos, False
        pos = end + 1
    if begin is not None:
        out.append((begin, len(text), kind))
    return out


def _depths(s: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of quotations and of brackets that are closed, as (place of the opening, place behind the closing)."""
    stack: list[tuple[str, int]] = []
    quotes, brackets = [], []
    for m in MARK.finditer(s):
        c, i = m[0], m.start()
        before, after = s[i - 1 : i], s[i + 1 : i + 2]
        if c in "\"'":
            if c == "'" and before.isalnum() and after.isalnum():
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)
            if k >= 0 and not (before.isspace() and after.isalnum()):
                quotes.append((stack[k][1], i + 1))
                del stack[k:]
            elif k < 0 and not after.isspace() and after and (not before or not before.isalnum()):
                stack.append((c, i))
            continue
        if c == "’" and before.isalpha() and after.isalpha():
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if PAIRS.get(stack[k][0]) == c), -1)
        if k >= 0:
            (brackets if c in ")]）】" else quotes).append((stack[k][1], i + 1))
            del stack[k:]
        elif c in PAIRS:
            stack.append((c, i))
    return quotes, brackets


def _closed(s: str, end: int, ends: set[int]) -> int:
    """Place behind the quotations and brackets that close right behind a mark."""
    while True:
        k = end + (s[end : end + 1] in ("\u00a0", "\u202f") or s[end : end + 2] == " »")
        if k + 1 not in ends:
            return end
        end = k + 1


def _split_score(s: str, end: int, mark: int, quotes: list[tuple[int, int]], brackets: list[tuple[int, int]], greek: bool) -> float:
    """How well a sentence closes before `end`, whose mark stands at `mark`, and another opens behind."""
    sign = CAND.match(s, mark)[0]
    closed = end > mark + len(sign)
    m = SPACE.match(s, end)
    blank = bool(m)
    start = m.end() if m else end
    if start >= len(s):
        return 0.0
    nxt, before = s[start], s[mark - 1 : mark]
    if set(sign) <= {";", ";"}:
        return 3.0 if greek and blank else -9.0
    if nxt in ",،、;:)]）】»”」』" or nxt in ".!?…":
        return -9.0
    # A letter behind opening marks decides about case.
    k = start
    while k < len(s) and (s[k] in "“„«「『（([‘\"'¿¡*_-—–•" or s[k].isspace()):
        k += 1
    first = s[k : k + 1]
    opened = k > start
    east = bool(CJK.match(before or " ")) or bool(CJK.match(nxt)) or (opened and bool(CJK.match(first or " "))) or (nxt in "“「『（《【" and bool(CJK.match(s[max(0, mark - 1) : mark] or " ")))
    full = any(c in "。！？।۔॥؟" for c in sign)
    ellipsis = sign.endswith(("...", "…")) and not any(c in "!?！？" for c in sign)
    if closed:
        span = next((q for q in quotes if q[1] == end), None) or next((q for q in brackets if q[1] == end), None)
        if span is None:
            return -2.0
        if span in brackets and span not in quotes:
            # Brackets stand alone if a sentence had ended before them.
            head = s[: span[0]].rstrip()
            alone = not head or head[-1] in ENDS + "”»」』\"'）)"
            return 4.0 if alone and not (first.islower() and blank) else -9.0
        if nxt in "と" or nxt in "—–":
            return -9.0 if nxt == "と" or re.match(r"[—–]\s*[^\W\d_]", s[start:]) else 2.0
        if CJK.match(nxt) and not KANA.match(nxt):
            clause = re.match("[^。！？；：]*", s[start:])[0]
            framed = s[: span[0]].rstrip().endswith(("：", ":"))
            if not framed and re.search(f"(?:{SPEECH})了?$", clause) and len(clause) <= 24:
                return -9.0
            return -9.0 if clause.startswith(("然后", "接着", "就", "便")) else 3.0
        if first.islower() and not _odd_opening(s[k:]):
            return -9.0
        return 3.0
    if east or (full and not blank):
        if ellipsis:
            return -9.0 if nxt in "但而却就" else 2.0
        return 3.0 if full or sign[-1] in "!?" else -9.0
    if not blank:
        # A missing blank: a word of two letters or more, a point, a capitalised word.
        if re.search(r"[^\W\d_]{2}$", s[max(0, mark - 4) : mark]) and before.islower() and first.isupper() and re.match(r"[^\W\d_]{2}|[AI]\s", s[k:]) and not opened:
            return 2.0
        if sign[-1] in "!?" and first.isupper() and before.isalpha():
            return 2.0
        return 2.0 if opened and before.islower() and first.isupper() and s[start] in "“„«「(" else -9.0
    if ellipsis:
        return -9.0 if first.islower() and not _odd_opening(s[k:]) else 2.0
    if any(c in "!?！？؟।۔॥。" for c in sign):
        return -4.0 if first.islower() and not _odd_opening(s[k:]) else 4.0
    # A single point.
    w = WORD_BEFORE.search(s[max(0, mark - 40) : mark])
    word = w[0] if w else ""
    low = word.lower()
    tail = low.rpartition(".")[2]
    follow = re.match(r"[\w.'’-]*", s[k:])[0]
    flow = follow.lower().rstrip(".")
    lower = first.islower() and not _odd_opening(s[k:])
    if re.match(r"\[\d+\]\s", s[start:]) and low not in GOES_ON:
        return 4.0
    if len(word) == 1 and word.isalpha() and word.isupper():
        return -5.0
    if low in MAY_END or (tail in {"h", "s"} and low == tail):
        if lower or first.isdigit():
            return -7.0
        return 2.0 if low in {"etc", "usw", "h", "s", "min", "a.m", "p.m", "pts", "др", "пр", "κ.λπ", "κ.ά"} or flow in OPENERS else 0.5
    if low in GOES_ON or (tail in GOES_ON and "." in low and len(tail) <= 3):
        return -6.0
    if len(word) == 1 and word.isalpha():
        return -6.0 if not first.isupper() else -3.0
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return -6.0 if lower else -2.0
    if word.isdigit() and len(word) <= 2 and (flow in ORDINAL_NEXT or lower):
        return -7.0
    if lower:
        return -3.0
    return 4.0


def _odd_opening(rest: str) -> bool:
    """Small letters that may open a sentence: e.g., file names, names like iFetch."""
    return bool(re.match(r"(?:e\.\s?g\.|i\.\s?e\.|z\.\s?B\.|p\.\s?ex\.|[a-z][\w-]*\.(?:json|txt|xml|log|csv|atom|yaml|yml|pdf|html?|md|js|py|png)(?![a-zA-Z])|[a-z]{1,2}[A-Z][a-z])", rest)) or bool(re.match(r"(?:[a-z0-9-]+\.)+(?:example|test|com|org|net)(?![a-zA-Z])", rest))


def starts(text: str) -> list[int]:
    """Code point offsets of the first characters of all sentences, in order. Null, empty and blank texts have none."""
    out: list[int] = []
    for a, b, heading in segments(text):
        s = text[a:b]
        lead = len(s) - len(s.lstrip())
        if heading:
            out.append(a + lead)
            continue
        item = LIST.match(s)
        out += [a + x for x in _spans(s, lead, item.end() if item else lead)]
    return out


def _spans(s: str, lead: int, body: int) -> list[int]:
    """Best cut of one segment: offsets of its sentences."""
    greek = bool(GREEK.search(s))
    cands: dict[int, tuple[float, int]] = {}
    quotes = brackets = None
    for m in CAND.finditer(s, body):
        if quotes is None:
            quotes, brackets = _depths(s)
            ends = {c for _, c in quotes + brackets}
        end = _closed(s, m.end(), ends)
        score = _split_score(s, end, m.start(), quotes, brackets, greek)
        nxt = SPACE.match(s, end)
        cands[nxt.end() if nxt else end] = (score, end)
    for m in THAI.finditer(s, body):
        cands[m.end()] = (3.0, m.start())
    if not cands:
        return [lead]
    if quotes is None:
        quotes, brackets = _depths(s)
    places = sorted(p for p in cands if lead < p < len(s) and cands[p][0] > -8)
    if not places:
        return [lead]
    nodes = [lead, *places, len(s)]
    inside = [0] * len(nodes)
    for o, c in quotes + brackets:
        for k, p in enumerate(nodes):
            if o < p < c:
                inside[k] += 1
            elif p >= c:
                break
    best, back, anchor = [0.0] + [float("-inf")] * (len(nodes) - 1), [0] * len(nodes), 0
    for j in range(1, len(nodes)):
        gain = 0.0 if j == len(nodes) - 1 else cands[nodes[j]][0]
        for i in range(j - 1, min(anchor, j - REACH) - 1 if j > REACH else -1, -1):
            v = best[i] + gain + _span_score(s, nodes[i], nodes[j], inside[i], inside[j])
            if v > best[j]:
                best[j], back[j] = v, i
        if inside[j] == 0 and gain >= 3:
            anchor = j
    cut, j = [], len(nodes) - 1
    while j > 0:
        j = back[j]
        cut.append(nodes[j])
    return cut[::-1]


def _span_score(s: str, i: int, j: int, inside_i: int, inside_j: int) -> float:
    """Length, opening and closing words and balanced quotations of a span, jointly."""
    score = -12.0 * (inside_i > 0) - 12.0 * (inside_j > 0)
    n = j - i
    if n < 4:
        score -= 2.0
    elif n > 400:
        score -= 0.002 * (n - 400)
    if n < 30 and re.match(r"(?s)(?:At|By|Until|From|Since|Um|Gegen|Vers|A las)\s.{0,14}\b(?:[ap]\.m\.|h\.|Uhr)\s*$", s[i:j]):
        score -= 5.0
    return score


def sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sent_no, start_pos, sentence) for every document. Null and blank texts give no rows; repeated rows repeat theirs."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, pos, sent = [], [], [], []
            keys = b.column(0)
            for r, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                at = starts(t)
                for k, p in enumerate(at):
                    ids.append(r)
                    no.append(k + 1)
                    pos.append(p)
                    sent.append(t[p : at[k + 1] if k + 1 < len(at) else len(t)].rstrip())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(ids, pa.int32())), pa.array(no, pa.int32()), pa.array(pos, pa.int64()), pa.array(sent, pa.string())], ["doc", "sent_no", "start_pos", "sentence"])

    found = docs.select(docs[doc].alias("doc"), docs[text].alias("text")).mapInArrow(run, f"doc {kind}, sent_no int, start_pos bigint, sentence string")
    return found.withColumnRenamed("doc", doc)
