"""Main body of web pages, by site style trees: importance of merged branches prunes, checks of the single page follow."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.text import site_of
from gleanspark.session import checkpointed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"div", "section", "aside", "nav", "form", "footer", "header", "article", "main", "table", "ul", "ol", "p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figure", "dl", "hr"}
BOXES = {"div", "section", "aside", "nav", "form", "footer", "header"}
AROUND = {"nav", "aside", "footer", "form"}
HIDDEN = {"script", "style", "title", "head", "noscript", "template"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w-]*)([^<>]*)>|\n|[^<\n]+|<", re.DOTALL)
CRUMB = re.compile(r"^[^.!?]{0,90}(?:\s(?:[>»›/→|]|&gt;)\s|^[^:]{0,20}:.*[>»›])")
LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
SENTENCE_END = re.compile(r"[.!?…。！？؟।:»”\"“'」）)]\s*$")
WORDY = re.compile(r"[^\W\d_]")
#: Elements that are branches of the style tree. A cell is one only where it holds other elements.
BRANCHES = BOXES | {"article", "main", "body", "td"}
#: A link to the top level of the site, alone in its line, belongs to a menu.
TOP_LEVEL = re.compile(r"/[^/?#]*/?")
#: Branches of less composite importance are pruned; the share of the presentation in it.
IMPORTANT, PRESENTATION = 0.45, 0.1
#: Nodes of fewer occurrences have no merged label; the least label that stays.
SEEN, STAYS = 2, 0.5


def subject(url: str | None) -> tuple[str, ...]:
    """Longer words of the last path segment of a page's address, without index and file endings."""
    path = re.split(r"[?#]", re.sub(r"^[a-z][a-z0-9+.-]*://[^/?#]*", "", (url or "").strip().lower()))[0].rstrip("/")
    last = re.sub(r"\.\w{2,5}$", "", re.sub(r"/index(?:\.\w{2,5})?$", "", path)).rpartition("/")[2]
    return tuple(w for w in re.split(r"[-_.+~]|%20", last) if len(w) >= 4)


def about(text: str, subj: tuple[str, ...]) -> bool:
    """Whether a line names what the page's address names."""
    low = text.lower()
    return any(w in low for w in subj)


def key_of(text: str, subj: tuple[str, ...], site: str | None) -> str:
    """A line as a content node of the merged tree: lower case, with numbers, the site's and the page's own name masked."""
    low = LINK.sub(r"\1", text).lower()
    for w in subj:
        low = low.replace(w, "\x01")
    for label in (site or "").split(".")[:2]:
        if len(label) > 4:
            low = low.replace(label, "\x02")
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", low)).strip(" -*•#|>")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def html_lines(text: str, subj: tuple[str, ...] | str) -> list[tuple[int, str, int, int, int, str, str, list[str]]]:
    """(line_no, text, block, standing, branch, path, child, leaves) of lines with visible text.

    standing: 1 main, 0 around it, by the page's own tree. branch numbers the branch of the tree that holds the line, 0 for
    the one with the title; path is its tags, child the tag below it that the line stands in, leaves its text nodes.
    """
    subj = (subj,) if subj and isinstance(subj, str) else subj
    stack: list[tuple[str, int, int, str]] = [("", -1, 0, "")]  # tag, id, line, attributes
    parents: dict[int, int] = {}
    tags: dict[int, tuple[str, int]] = {}
    nodes: list[tuple[int, str, tuple[int, ...], str]] = []
    line, n, hidden = 1, 0, ""
    title = None
    for m in TOKEN.finditer(text):
        t = m[0]
        if t == "\n":
            line += 1
            continue
        name = (m[2] or "").lower()
        if hidden:
            line += t.count("\n")
            if m[1] and name == hidden:
                hidden = ""
            continue
        if not name:
            if t.startswith("<!--"):
                line += t.count("\n")
            elif t.strip():
                nodes.append((line, html.unescape(t), tuple(x[1] for x in stack), next((x[3] for x in reversed(stack) if x[0] == "a"), "")))
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k:
                del stack[k:]
        elif name in HIDDEN and name != "head":
            hidden = "" if m[3].rstrip().endswith("/") else name
        elif name not in VOID:
            if name in BLOCKS and stack[-1][0] == "p":
                stack.pop()
            same = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(name)
            while same and stack[-1][0] in same | {"p", "a", "span"} and any(x[0] in same for x in stack[-3:]):
                stack.pop()
            if name == "a" and stack[-1][0] == "a":
                stack.pop()
            n += 1
            parents[n], tags[n] = stack[-1][1], (name, line)
            stack.append((name, n, line, m[3]))
            if name == "h1" and title is None and not any(x[0] in AROUND for x in stack):
                title = n
        line += t.count("\n")
    if not nodes:
        return []
    if title is not None:
        container = parents[title]
    else:  # the deepest element under which most of the lines with the page's name lie
        votes: dict[int, int] = {}
        for no, t, path, _ in nodes:
            if about(t, subj) and len(t) > 40 and len(path) > 1:
                box = next((x for x in reversed(path) if x in tags and tags[x][0] in BOXES | {"article", "main", "body", "td"} and tags[x][1] != no), -1)
                votes[box] = votes.get(box, 0) + 1
        container = max(votes, key=votes.get) if votes else -1
    by_line: dict[int, list] = {}
    for no, t, path, href in nodes:
        by_line.setdefault(no, []).append((t, path, href))
    rows = []
    for no, parts in sorted(by_line.items()):
        joined = " ".join(p[0].strip() for p in parts)
        if not WORDY.search(joined) and not re.search(r"\d", joined):
            continue
        path = parts[0][1]
        below = path[path.index(container) + 1 :] if container in path else None
        box = next((x for x in below or () if tags[x][0] in BOXES), 0)
        if title is not None and no < tags[title][1] or below is None:
            standing, block = 0, -1
        elif not box:
            href = parts[0][2]
            at = re.search(r"href\s*=\s*[\"']?([^\"'\s>]*)", href)
            menu = all(p[2] for p in parts) and at is not None and TOP_LEVEL.fullmatch(at[1]) is not None
            standing, block = (0 if menu else 1), 0
        else:
            direct = path[-1] == box and tags[box][1] == no
            standing, block = (1 if direct else 0), (0 if direct else box)
        chain = [x for x in path if x in tags and tags[x][0] not in ("html", "head")]
        k = len(chain) - 1
        if k >= 0 and tags[chain[k]][0] == "div":  # a div that holds text is a leaf
            k -= 1
        while k >= 0 and (tags[chain[k]][0] not in BRANCHES or tags[chain[k]][0] == "td" and k == len(chain) - 1):
            k -= 1
        branch = chain[k] if k >= 0 else -1
        child = tags[chain[k + 1]][0] if k + 1 < len(chain) else "#"
        rows.append([no, joined, block, standing, 0 if branch == container else branch, "/".join(tags[x][0] for x in chain[: k + 1]), child, [p[0] for p in parts]])
    # A box that holds the page's own text is a wrapper, whatever it is called.
    for b in {r[2] for r in rows if r[2] > 0}:
        own = [r for r in rows if r[2] == b]
        if subj and tags[b][0] not in AROUND and sum(about(r[1], subj) and not CRUMB.search(r[1]) for r in own) >= max(1, 0.4 * len(own)):
            for r in own:
                r[3] = 1
    return [tuple(r) for r in rows]


def plain_lines(text: str, subj: tuple[str, ...], markdown: bool) -> list[tuple[int, str, int, int]]:
    """As html_lines, for markdown and text. standing -1: the page alone doesn't tell."""
    lines = text.split("\n")
    first = next((k for k, x in enumerate(lines) if re.match(r"#\s+\S", x)), None) if markdown else None
    if first is None and subj:
        cand = [k for k, x in enumerate(lines) if about(x, subj) and not CRUMB.search(x.strip())]
        first = cand[0] if cand else None
    rows, block, fence = [], 0, False
    for k, raw in enumerate(lines):
        x = raw.strip()
        if markdown and x.startswith("```"):
            fence = not fence
            continue
        if not x:
            block += not fence
            continue
        if not WORDY.search(x) and not re.search(r"\d", x) or re.fullmatch(r"[|:\-\s]+", x):
            continue
        links = LINK.findall(x)
        rest = LINK.sub("", x).strip(" -*•|·")
        if first is not None and k < first:
            standing = 0
        elif fence or markdown and (x.startswith("|") or re.match(r"#{1,6}\s", x)):
            standing = 1
        elif links and not rest and all(TOP_LEVEL.fullmatch(u) for _, u in links):
            standing = 0
        elif about(x, subj):
            standing = 0 if CRUMB.search(x) else 1
        else:
            standing = -1
        rows.append((k + 1, x, block, standing))
    return rows


def _nodes(pages: DataFrame, page: str) -> DataFrame:
    """One row per line with text: where it stands in its page's tree, and its nodes in the merged tree as hashes."""
    body = F.when(F.lower("content_type").contains("html"), F.col("html")).otherwise(F.col("content"))
    rows = pages.where("only_main_content is null or only_main_content").select(F.col(page).alias("page"), site_of(F.col("url")).alias("host"), F.col("url").alias("url"), F.lower("content_type").alias("kind"), body.alias("body")).where("body is not null")
    # Deliveries of a page are told apart by a digest, so that bodies aren't compared.
    rows = rows.withColumn("_digest", F.xxhash64("url", "kind", "body")).dropDuplicates(["page", "_digest"]).drop("_digest")
    ptype = rows.schema["page"].dataType.simpleString()
    names = ["page", "host", "line_no", "block", "standing", "key", "lead", "look", "html", "branch", "path", "style", "leaves", "chars"]
    kinds = [b_type(ptype), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for p, h, u, k, t in zip(*(c.to_pylist() for c in b.columns)):
                s, is_html = subject(u), "html" in (k or "")
                lines = html_lines(t, s) if is_html else [(*x, -1, "", "", []) for x in plain_lines(t, s, k == "markdown")]
                below: dict[int, set[str]] = {}
                for x in lines:
                    below.setdefault(x[4], set()).add(x[6])
                style = {branch: _hash("|".join(sorted(children))) for branch, children in below.items()}
                for no, x, block, standing, branch, path, _, parts in lines:
                    key = key_of(x, s, h)
                    lead = re.split(r" [|·-] |(?<=[.!?]) ", key)[0]
                    leaves = [y for y in parts if WORDY.search(y) or re.search(r"\d", y)]
                    out.append((p, h or "", no, block, standing, _hash(key), _hash(lead), _look(LINK.sub(r"\1", x).strip()), is_html, branch, _hash(path), style[branch], [_hash(key_of(y, s, h)) for y in leaves], [len(y.strip()) for y in leaves]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(run, f"page {ptype}, host string, line_no int, block int, standing int, key bigint, lead bigint, look int, html boolean, branch int, path bigint, style bigint, leaves array<bigint>, chars array<int>")


def b_type(name: str) -> pa.DataType:
    """Arrow type of a key column."""
    return {"bigint": pa.int64(), "int": pa.int32()}.get(name, pa.string())


def _look(x: str) -> int:
    """2 a sentence, 1 a list item or row, 0 a title or label."""
    bare = x.lstrip("-*• ").lstrip("0123456789. ")
    if len(x) >= 40 and SENTENCE_END.search(x):
        return 2
    if bare[:1].islower() or (x[:1] in "-*•" and not bare[:1].isupper()) or re.search(r"\d\s*$", x) and len(re.findall(r"\d[\d.,]*", x)) >= 2:
        return 1
    return 0


def branch_importance(nodes: DataFrame) -> DataFrame:
    """(page, branch, importance): composite importance of the branches of HTML pages in their sites' style trees.

    Trees of one host are merged by path. A content node is the masked text
    of a leaf, of which a line may hold several: on n of m pages of the host its entropy is
    log n / log m, and its importance what is left of 1; hosts are merged the same way, so that what all hosts show alike
    counts as little as what all pages of one do. A presentation node is a path with the tags below it: the entropy of
    these over the pages that have the path is its own importance. A branch's importance is the mean of that of its
    leaves by their length, of the branches of its host that look alike, and of those of all hosts, and a share of its
    presentation's. Everything is counted per host and node before it is shuffled, so no host or line is gathered.
    """
    lines = nodes.where("html").select("page", "host", "branch", "path", "style", F.explode(F.arrays_zip(F.col("leaves").alias("key"), F.col("chars").alias("chars"))).alias("leaf")).select("page", "host", "branch", "path", "style", "leaf.key", "leaf.chars")
    sizes = lines.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("m"))
    hosts = sizes.agg(F.greatest(F.lit(2), F.count("*")).alias("hosts"))
    per_host = lines.select("host", "key", "page").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    per_key = per_host.groupBy("key").agg(F.count("*").alias("k"))
    entropy = F.greatest(F.log("n") / F.log(F.greatest(F.lit(2), F.col("m"))), F.log("k") / F.log("hosts"))
    content = per_host.join(sizes, "host").join(per_key, "key").join(F.broadcast(hosts)).select("host", "key", (1 - F.least(entropy, F.lit(1.0))).alias("content"))
    held = lines.join(content, ["host", "key"]).groupBy("page", "branch", "host", "path", "style").agg((F.sum(F.col("chars") * F.col("content")) / F.sum("chars")).alias("own"))
    alike = held.groupBy("host", "path", "style").agg(F.avg("own").alias("alike"), F.count("*").alias("c"))
    # The entropy of the styles of a path: log N - sum(c log c) / N, over log N.
    paths = alike.groupBy("host", "path").agg(F.sum("c").alias("N"), F.sum(F.col("c") * F.log("c")).alias("s")).select("host", "path", F.when(F.col("N") > 1, (F.log("N") - F.col("s") / F.col("N")) / F.log("N")).otherwise(1.0).alias("shown"))
    anywhere = alike.groupBy("path", "style").agg(F.avg("alike").alias("anywhere"))
    merged = alike.join(anywhere, ["path", "style"]).join(paths, ["host", "path"]).select("host", "path", "style", "alike", "anywhere", "shown")
    whole = (1 - PRESENTATION) * (F.col("own") + F.col("alike") + F.col("anywhere")) / 3 + PRESENTATION * F.col("shown")
    return held.join(merged, ["host", "path", "style"]).select("page", "branch", whole.alias("importance"))


def labels(nodes: DataFrame) -> DataFrame:
    """(key, seen, weight): how far a content node stands in main branches of HTML pages, for pages whose own tree doesn't tell.

    Hosts are merged each by log2 of its lines with the node, plus 1: a host of a third of all pages has little more say than others.
    """
    known = nodes.where("standing >= 0 and html").groupBy("key", "host").agg(F.sum("standing").alias("main"), F.count("*").alias("n"))
    h = F.log2("n") + 1
    return known.groupBy("key").agg(F.sum("n").alias("seen"), (F.sum(h * F.col("main") / F.col("n")) / F.sum(h)).alias("weight"))


def main_lines(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, line_no): lines of the main body, for pages whose only_main_content is true or null.

    Branches of little importance in their site's style tree are pruned, but for the one that holds the title. On what is left
    of an HTML page its own tree is checked: what stands before the title, in menus, or in boxes beside the text goes too.
    Markdown and text have no branches: there the page itself tells by its title, tables and code, and content nodes
    merged over all HTML pages for the rest. Null bodies give no rows; lines without letters or digits, as tags, fences
    and rulers, are none; repeated rows count once.
    """
    nodes = checkpointed(_nodes(pages, page))
    weights = labels(nodes)
    whole = weights.select("key", F.col("seen").alias("s1"), F.col("weight").alias("w1"))
    lead = weights.select(F.col("key").alias("lead"), F.col("seen").alias("s2"), F.col("weight").alias("w2"))
    label = F.when(F.col("s1") >= SEEN, F.col("w1")).when(F.col("s2") >= SEEN, F.col("w2"))
    plain = nodes.where("not html").join(whole, "key", "left").join(lead, "lead", "left").select("page", "line_no", "block", "standing", "look", label.alias("weight"))
    pruned = branch_importance(nodes).where(F.col("importance") < IMPORTANT).where("branch <> 0").select("page", "branch")
    html_ = nodes.where("html and standing = 1").join(whole, "key", "left").where(~F.coalesce((F.col("s1") >= SEEN) & (F.col("w1") < 0.2), F.lit(False)))
    kept = html_.join(pruned, ["page", "branch"], "left_anti").select("page", "line_no")
    ptype = nodes.schema["page"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a page come one after the other; what the last line was is carried over batches."""
        at, last, last_block, sure = None, 0, None, False
        for b in batches:
            keep = []
            for k, (p, block, standing, look, weight) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)))):
                if p != at:
                    at, last, last_block, sure = p, 0, None, False
                if standing >= 0:
                    main = standing == 1
                elif weight is not None:
                    main = weight >= STAYS
                elif look:
                    main = True
                else:  # a label that stands nowhere else: what is before it in the block tells, and titles follow labels
                    main = block == last_block and last == 1 and sure
                sure = weight is not None or standing >= 0 or look > 0 or (sure and block == last_block)
                last, last_block = int(main), block
                if main:
                    keep.append(k)
            chosen = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(chosen), b.column(1).take(chosen)], ["page", "line_no"])

    told = plain.repartition("page").sortWithinPartitions("page", "line_no").mapInArrow(decide, f"page {ptype}, line_no int")
    return kept.unionByName(told).distinct().withColumnRenamed("page", page)


def main_content(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, text): the main body of each page whose only_main_content is true or null; the whole text otherwise.

    Pages of which nothing stays have an empty text; null bodies stay null.
    """
    body = F.when(F.lower("content_type").contains("html"), F.col("html")).otherwise(F.col("content"))
    rows = pages.select(F.col(page).alias("_p"), body.alias("_t"), F.coalesce("only_main_content", F.lit(True)).alias("_m")).distinct()
    kept = main_lines(pages, page).groupBy(F.col(page).alias("_k")).agg(F.collect_set("line_no").alias("_keep"))
    tags = F.regexp_replace(F.array_join(F.filter(F.transform(F.split("_t", "\n", -1), lambda x, i: F.when(F.array_contains("_keep", i + 1), x)), lambda x: x.isNotNull()), "\n"), "<[^>]*>", "")
    return rows.join(kept, F.col("_p") == F.col("_k"), "left").select(F.col("_p").alias(page), F.when(~F.col("_m") | F.col("_t").isNull(), F.col("_t")).otherwise(F.coalesce(tags, F.lit(""))).alias("text"))
