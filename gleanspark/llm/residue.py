"""Template residue, filler text, error pages and script notices in place of content."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled exemplars of residue. One sentence each; names, hosts and numbers are left out.
MESSAGES = """
Access was refused|Prove that you are not a robot|Prove that you are no robot: tick all boats|Access denied|Your address was refused by the gate of
The page could not be found on this server|page not found|Not found|Request timed out after s (upstream)|No route matches [GET]|Seite existiert nicht mehr
Sorry, has moved and left no new address|Error while rendering: template returned nothing|Something went wrong|Reload|Account suspended
Uncaught TypeError: title of null at line|Fatal: out of memory while drawing the template|We are down for maintenance, back soon
HTTP upstream sent no headers|Empty response from origin|Bad gateway (edge)|Gateway time-out: the machine behind gave no answer|Gone
Too many requests|Slow down and come back in seconds|Session expired|Log in again to read this page|You must be signed in to continue
Internal server error|Our team was told|Code b|Service Unavailable|The server is resting, try again in a few minutes
Oops|We looked everywhere, but this page is gone|The link you followed may be broken, or the page may have been taken down
This item is no longer available|The requested document was removed by its owner|Your request was blocked by the firewall|Event id
Not available in your country|This domain is parked|Ask the owner of for details|Checking that you are human before you enter|This takes a few seconds
Accès refusé|Erreur : une erreur est survenue sur le serveur|Страница не найдена|您访问的页面不存在|お探しのページは見つかりませんでした
La página que busca no existe o fue movida|Se ha producido un error inesperado|Die angeforderte Seite wurde nicht gefunden
Der Dienst ist zurzeit nicht erreichbar|Bitte später erneut versuchen|An unexpected error occurred|Please try again later|Forbidden|You do not have permission to view this page
Verify you are human|Please log in to continue|This content has been removed
"""
SCRIPTS = """
is being drawn in your browser|Without JavaScript it stays empty|To open your browser must run scripts
Scripts are blocked in your browser, so nothing can be shown here|Ce site ne fonctionne pas sans scripts|Veuillez activer JavaScript pour afficher cette page
This site needs scripts to run|Turn them on and reload|Turn off the script blocker to read|Per continuare attiva gli script del browser
JavaScript が無効です|有効にしてから再読み込みしてください|Please switch on JavaScript to see this page|请启用 JavaScript 后继续浏览
Ihr Browser führt keine Skripte aus, daher bleibt diese Ansicht leer|Please allow active content and press reload|Sem scripts esta página não pode ser aberta
Loading|If nothing happens, allow scripts for|Для просмотра страницы включите JavaScript|We noticed that scripts are off in your client|cannot work like that
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen|Your browser does not run scripts or is too old for|Update it to go on
Este sitio necesita scripts para funcionar|noscript: this view is drawn in the browser|You need to enable JavaScript to run this app
This application requires a client with ECMAScript support|Active JavaScript en su navegador para continuar|This page requires JavaScript
"""
FILLER = """
Add a short description of this section|Sample paragraph, replace before launch|Hier steht ein Blindtext, er wird später ersetzt|xxx xxx xxx
This is dummy text|It stands here until the real text is ready|asdf asdf asdf qwer qwer test test|Put your own words here, then delete this line
Texto de relleno, pendiente de redactar|Texte provisoire à remplacer|Beispieltext Beispieltext Beispieltext
Product description coming soon, this is only a stand-in|Your content here|Heading goes here|subheading goes here|Text text text text text text|Copy to follow
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
"""
#: Words that stand for filler by themselves. Those that keep them company are learned from all documents.
SEEDS = ("lorem", "ipsum")
#: Further words of the text that printers have set for centuries; others are learned.
KNOWN = ("dolor", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore", "magna", "aliqua")
#: A word is filler if it is in so large a share of the documents with a seed, in three of them at least, half of its
#: documents have one, and it stands three times in sentences that are made of such words in so large a part: text that
#: writes about filler has words of its own. By the first no more words can be learned than a document has on average,
#: divided by the share.
COMPANY, LEAST, FAITHFUL, PURE = 0.05, 3, 0.5, 0.8
#: What follows a message and says nothing of its own.
TAILS = "Reference|Go to the start page or use the search|Zurück zur Startseite|Try later|Notice|Error|Fehler"

#: Marks of templates that were not filled, as exemplars: a mark is a token of its shape, whatever the name in it.
PLACEHOLDERS = "{{name}}|${name}|#{name}|<% name %>|@@NAME@@|[[name]]|%name%|__NAME__|[NAME_PLACEHOLDER]|[insert name]|[your name]|XXX name XXX|TODO: name|*¦NAME¦*|[object Object]|{0}|[Intro text]|&lt;name&gt;|undefined undefined|NaN of NaN"
#: What may be a mark.
MARK = re.compile(
    r"@@[\w.]+@@|\[\[[\w. ]{1,60}\]\]|%[A-Za-z_][\w.]{2,}%|\b__[A-Z][A-Z0-9_]*__|\[[A-Z][A-Z0-9_]*_PLACEHOLDER\]|\[(?:insert|your) [^\]\n]{1,60}\]"
    r"|\bXXX [\w.]+ XXX\b|\bTODO: \w+|\*\|[\w.]+\|\*|\[object Object\]|(?<![\w{$#])\{\d+\}|\[Intro text[^\]\n]{0,40}\]|&lt;\w+&gt;|\bundefined undefined\b|\bNaN of NaN\b",
    re.IGNORECASE,
)
#: Marks between an opening and a closing sign, of any length and over lines.
SIGNS = (("{{", "}}"), ("${", "}"), ("#{", "}"), ("<%", "%>"))
CASED = re.compile(r"__[A-Z]|_PLACEHOLDER|XXX|TODO")
MARK_SIGNS = re.compile(r"[{\[<%@_*&]|XXX|TODO|undefined|NaN")
CODE = re.compile(r"(?ms)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\S\n]*$|\Z)|`[^`\n]*`")
TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\.\.\.|\s[-–|]\s|\n")

#: Windows end at these signs only, at each twice at most.
ENDS = ".!?。！？-–|\n"

#: A window is matched if it holds so much of the exemplar's TF-IDF mass, and the exemplar so much of the window's; a text
#: is a message if matched windows make up so much of it.
EXEMPLAR_SHARE, WINDOW_SHARE, FILLER_SHARE, COVERAGE = 0.7, 0.5, 0.7, 0.6


def shape(mark: str) -> str:
    """The token of a mark: its signs, and its words where they are what makes it a mark."""
    low = mark.lower()
    for word in ("_placeholder]", "[insert ", "[your ", "xxx", "todo:", "[object object]", "[intro text", "undefined undefined", "nan of nan"):
        if word in low:
            return word
    return re.match(r"_*[^\w\s]*", mark)[0] + re.search(r"[^\w\s]*_*\Z", mark)[0] or mark


def exemplars() -> list[tuple[str, str]]:
    """(kind, text) of the labelled exemplars that come with the operator."""
    out = [("placeholder", s.replace("¦", "|")) for s in PLACEHOLDERS.split("|")]
    for kind, text in (("message", MESSAGES), ("script", SCRIPTS), ("filler", FILLER), ("tail", TAILS)):
        out += [(kind, s) for s in re.split(r"[|\n]", text) if s.strip()]
    return out


def tokens_of(labelled: Sequence[tuple[str, str]], learned: Sequence[str]) -> list[tuple[str, tuple[str, ...]]]:
    """The exemplars as tokens, and the words of filler as one more."""
    out = [(kind, (f"\0{shape(text)}",) if kind == "placeholder" else tuple(TOKEN.findall(text.lower()))) for kind, text in labelled]
    return [*out, ("latin", tuple(dict.fromkeys((*SEEDS, *KNOWN, *learned))))]


def marks(text: str) -> Iterator[str]:
    """The marks of a text: those that MARK finds, and what stands between signs, of any length and over lines."""
    for opening, closing in SIGNS:
        at = text.find(opening)
        if at >= 0 and text.find(closing, at + 2) >= 0:
            yield opening + " " + closing
    for m in MARK.finditer(text):
        if not CASED.search(m[0].upper()) or CASED.search(m[0]):
            yield m[0]


class Index:
    """Inverted index over the exemplars, with inverse document frequencies of the corpus."""

    def __init__(self, df: dict[str, int], n: int, labelled: Sequence[tuple[str, str]] | None = None, learned: Sequence[str] = ()):
        self.exemplars = tokens_of(exemplars() if labelled is None else labelled, learned)
        self.unknown = math.log((n + 1) / 2) * 0.6 + 1
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, e in self.exemplars for t in e}
        self.post: dict[str, list[int]] = {}
        self.mass = []
        self.anchors: set[str] = set()
        self.fill: set[str] = set()
        for k, (kind, e) in enumerate(self.exemplars):
            for t in set(e):
                self.post.setdefault(t, []).append(k)
            self.mass.append(sum(self.idf[t] for t in set(e)))
            # Without one of its weightiest tokens no window reaches the share, so only those are looked for at first.
            left = self.mass[-1]
            for t in sorted(set(e), key=lambda t: -self.idf[t]):
                if kind == "placeholder":
                    continue
                if kind == "latin" or left >= EXEMPLAR_SHARE * self.mass[-1]:
                    self.anchors.add(t)
                    if kind in ("filler", "latin"):
                        self.fill.add(t)
                left -= self.idf[t]

    def match(self, tokens: list[str]) -> set[str]:
        """Kinds of the exemplars that a window matches."""
        counts = Counter(tokens)
        window = sum(self.idf.get(t, self.unknown) * c for t, c in counts.items())
        held: dict[int, float] = {}
        weight: dict[int, float] = {}
        for t, c in counts.items():
            for k in self.post.get(t, ()):
                held[k] = held.get(k, 0.0) + self.idf[t]
                weight[k] = weight.get(k, 0.0) + self.idf[t] * c
        kinds = set()
        for k, m in held.items():
            kind = self.exemplars[k][0]
            share = weight[k] / window
            if kind == "latin":
                if len(tokens) >= 4 and share >= FILLER_SHARE:
                    kinds.add("filler")
            elif m >= EXEMPLAR_SHARE * self.mass[k] and share >= (FILLER_SHARE if kind == "filler" else WINDOW_SHARE):
                kinds.add(kind)
        return kinds

    def judge(self, title: str | None, content: str | None) -> str | None:
        """placeholder, filler, message or script, or None for a text of its own."""
        for text in (title, content):
            if text and MARK_SIGNS.search(text):
                bare = CODE.sub(" ", text) if "`" in text else text
                # A mark is a window of one token, so the exemplars of its posting contain it whole.
                if any("placeholder" in self.match([f"\0{shape(m)}"]) for m in marks(bare)):
                    return "placeholder"
        for text, of_title in ((title, True), (content, False)):
            if not text:
                continue
            low = text.lower()
            if "`" in low:
                low = CODE.sub(" ", low)
            words = TOKEN.findall(low)
            if self.anchors.isdisjoint(words):
                continue
            # Matched windows make up COVERAGE of the mass, and exemplars WINDOW_SHARE of theirs, so less can't do. Each window
            # may be a lone name, which has no mass.
            mass = [self.idf.get(t, 0.0) for t in words]
            known = sum(mass)
            foreign = max(0, mass.count(0.0) - 1 - 2 * sum(map(low.count, ENDS)))
            enough = known >= WINDOW_SHARE * COVERAGE * (known + self.unknown * foreign) - 1e-9
            if not enough and self.fill.isdisjoint(words):
                continue
            kinds: Counter[str] = Counter()
            total = 0.0
            for line in SENTENCE.split(low):
                tokens = TOKEN.findall(line or "")
                # A name or address alone says nothing.
                if not tokens or (len(tokens) == 1 and tokens[0] not in self.idf):
                    continue
                got = self.match(tokens) if not self.anchors.isdisjoint(tokens) else set()
                if "filler" in got:
                    return "filler"
                weight = sum(self.idf.get(t, self.unknown) for t in tokens)
                total += weight
                for k in got:
                    kinds[k] += weight
                if got & {"message", "script", "tail"}:
                    kinds["covered"] += weight
            if not of_title and total and (kinds["message"] or kinds["script"]) and kinds["covered"] >= COVERAGE * total:
                return "script" if kinds["script"] > kinds["message"] else "message"
        return None


def _seeded(docs: DataFrame, text: str) -> DataFrame:
    # Seeds in lower case, capitalised or in capitals are what texts have; lower() of all texts would cost more than the rest.
    spelled = [F.col(text).contains(x) for s in SEEDS for x in (s, s.capitalize(), s.upper())]
    held = spelled[0]
    for x in spelled[1:]:
        held = held | x
    return docs.where(F.col(text).isNotNull() & held).select(F.col(text).alias("t"))


def pure_words(docs: DataFrame, text: str, faithful: frozenset[str]) -> DataFrame:
    """(token): those of the faithful words that stand in sentences made of them, LEAST times or more."""
    held = faithful | set(SEEDS) | set(KNOWN)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for c in b.column(0).to_pylist():
                for sentence in SENTENCE.split(c.lower()):
                    tokens = TOKEN.findall(sentence or "")
                    inside = [t for t in tokens if t in held]
                    if len(inside) >= max(4, PURE * len(tokens)):
                        seen.update(inside)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    return _seeded(docs, text).mapInArrow(words, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("token")


def filler_words(docs: DataFrame, text: str) -> DataFrame:
    """(token, company): words in at least COMPANY of the documents with a seed, and how many of these have each.

    At most 1 / COMPANY times the words that such a document has on average, however many documents there are.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        for b in batches:
            for c in b.column(0).to_pylist():
                held = set(TOKEN.findall(c.lower()))
                if not held.isdisjoint(SEEDS):
                    n += 1
                    seen.update(held)
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([n, *seen.values()], pa.int64())], ["token", "company"])

    counts = _seeded(docs, text).mapInArrow(words, "token string, company bigint").groupBy("token").agg(F.sum("company").alias("company"))
    whole = counts.where("token = ''").select(F.greatest(F.lit(LEAST), F.ceil(F.col("company") * COMPANY)).alias("least"))
    return counts.join(F.broadcast(whole)).where("token <> '' and company >= least").select("token", "company")


def residue(docs: DataFrame, doc: str = "scrape_id", title: str = "title", content: str = "content", labelled: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(doc, kind): the documents to exclude, each once, with placeholder, filler, message or script.

    labelled are the exemplars, (kind, text) with kinds placeholder, filler, message, script and tail (what may follow a
    message); exemplars() where there are none. Frequencies of their tokens are counted over all documents, and the words
    that keep company with filler are learned from them. Code between backticks or fences is passed over, since it shows
    marks on purpose. Null and blank texts are none. Rows of one document with different verdicts give the first in
    alphabetical order.
    """
    base = docs.select(F.col(doc).alias("doc"), F.col(title).alias("title"), F.col(content).alias("content"))
    kind = base.schema["doc"].dataType.simpleString()
    near = {r.token: r.company for r in filler_words(base, "content").collect()}  # 20 times the words of a document
    known = {t for _, e in tokens_of(exemplars() if labelled is None else labelled, ()) for t in e}
    vocabulary = known | near.keys()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        for b in batches:
            for c in b.column(0).to_pylist():
                if c:
                    n += 1
                    seen.update(vocabulary.intersection(TOKEN.findall(c.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([n, *seen.values()], pa.int64())], ["token", "n"])

    found = {r.token: r.n for r in base.select("content").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()}  # as many rows as the vocabulary has tokens
    n = found.pop("", 0)
    faithful = frozenset(t for t, c in near.items() if c >= FAITHFUL * found.get(t, 0))
    learned = sorted({r.token for r in pure_words(base, "content", faithful).collect()} - set(SEEDS))  # some of the faithful

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(found, n, labelled, learned)
        for b in batches:
            verdicts = [index.judge(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            hit = pa.array([k for k, v in enumerate(verdicts) if v], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), pa.array([v for v in verdicts if v], pa.string())], ["doc", "kind"])

    return base.mapInArrow(run, f"doc {kind}, kind string").groupBy("doc").agg(F.min("kind").alias("kind")).withColumnRenamed("doc", doc)
