import collections
import random

from gleanspark.llm.main_content import html_lines, main_content, main_lines
from gleanspark.llm.mixing import Mixer
from gleanspark.llm.packing import best_fit, complete, pack


def test_bin_completion():
    rng = random.Random(1)
    assert len(complete([6, 5, 4, 3, 2], 10)) == 2 and len(complete([], 10)) == 0
    assert len(best_fit([7, 6, 5, 4, 4, 4], 15)) == 3 and len(complete([7, 6, 5, 4, 4, 4], 15)) == 2
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))), reverse=True)
        bins = complete(sizes, 60)
        assert sorted(x for b in bins for x in b) == list(range(len(sizes)))
        assert all(sum(sizes[x] for x in b) <= 60 for b in bins)
        assert -(-sum(sizes) // 60) <= len(bins) <= len(best_fit(sizes, 60))
    # Best fit decreasing needs three here, the optimum is two.
    assert len(best_fit([5, 4, 4, 3, 2, 2], 10)) == 3 and len(complete([5, 4, 4, 3, 2, 2], 10)) == 2


def test_pack(spark):
    rng = random.Random(2)
    texts = ["é" * rng.randrange(1, 700) for _ in range(150)] + [None, "", "x" * 4096, "y" * 5000]
    docs = spark.createDataFrame([(k, t, "a", 7) for k, t in enumerate(texts)] + [(0, texts[0], "a", 7)], "doc_id bigint, text string, capacity string, size int")
    caps = spark.createDataFrame([("s", 1000), ("m", 4096), ("z", 0), (None, None)], "container string, capacity int")
    rows = pack(docs, caps).collect()
    size = {k: len(t.encode()) if t else 0 for k, t in enumerate(texts)}
    for cap in (1000, 4096):
        own = [r for r in rows if r.capacity == cap]
        room, doc = collections.Counter(), collections.defaultdict(list)
        for r in own:
            room[r.container_no] += r.size
            doc[r.doc_id].append(r)
        assert max(room.values()) <= cap and set(doc) == set(size)
        assert all(sum(r.size for r in v) == size[k] and (len(v) > 1) == (size[k] > cap) for k, v in doc.items())
        assert len(room) <= sum(size.values()) / cap * 1.1 + 1
    assert pack(docs.limit(0), caps).count() == 0 and pack(docs, caps.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    docs = [(k, rng.choice("ab") + " word " * rng.randrange(1, 60), rng.choice(["Web ", "web", "BOOK", "talk", None])) for k in range(400)] + [(900, None, "web"), (901, "", "book")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([(1, " Web", 0.5, 2), (1, "book", 0.5, 3), (2, "web", 0.1, 1), (2, "talk", 0.9, 1), (2, "none", 0.2, 5), (3, "web", None, 1), (4, "web", 3.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    mixer = Mixer(df, goals)
    report = {(r.mix_id, r.source): r for r in mixer.report().collect()}
    tokens = collections.Counter()
    for _, t, s in docs:
        if s:
            tokens[s.strip().lower()] += len((t or "").encode())
    for (m, s), r in report.items():
        of = {x: v for (y, x), v in report.items() if y == m}
        whole = sum(tokens[x] for x in of)
        cap = {(1, "web"): 2, (1, "book"): 3, (2, "none"): 5}.get((m, s), 1)
        assert r.reachable == (not r.target_share * whole > cap * tokens[s])
    assert abs(report[1, "web"].reached_share - 0.5) < 0.06 and not report[2, "none"].reachable and (3, "web") not in report
    assert all(r.repeats <= 3 for r in mixer.chosen().collect())
    assert Mixer(df, goals.limit(0)).report().count() == 0 and Mixer(df.limit(0), goals).report().where("not reachable").count() == 0


PAGE = """<!doctype html>
<html><head><title>Lomikaru | Site</title></head>
<body>
<div class="c1">
<span>Home</span>
<a href="/1">Shop</a>
</div>
<article>
<h1>Why Lomikaru stays</h1>
<p>Lomikaru kept its kettles with care and nobody asked for a refund.
<div>
<p>Three more like this</p>
<a href="/2">A visit to Vanorupi</a>
</div>
<div class="big">Background</div>
<ul><li><a href="/lomikaru/3">early maps</a></li></ul>
<table>
<tr><td>forum</td><td>12</td></tr>
</table>
<pre><code>
fetch --site lomikaru
</code></pre>
<footer>
<p>All rights reserved</p>
</footer>
</div>
</body></html>"""


def test_page_tree():
    assert [r[0] for r in html_lines(PAGE, "lomikaru") if r[3] == 1] == [9, 10, 15, 16, 18, 21]
    assert html_lines("", "x") == [] and html_lines("<p>a<b", "") != []


def test_main_lines(spark):
    md = "Home\nShop\n\n# On Lomikaru\n\nLomikaru kept its kettles with great care all year.\n\n```\nrun 1\n```\n\n- [Shop](/1)\n\n| a | 1 | 2 |\n|---|---|---|"
    rows = [(1, "https://a.test/x/lomikaru.html", PAGE, None, "html", True), (2, "https://a.test/lomikaru", None, md, "markdown", None), (3, "https://a.test/lomikaru", PAGE, None, "html", False), (4, None, None, None, "html", True), (5, None, "", None, "html", True), (1, "https://a.test/x/lomikaru.html", PAGE, None, "html", True)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, content string, content_type string, only_main_content boolean, line_no int")
    got = collections.defaultdict(set)
    for r in main_lines(df).collect():
        got[r.page_id].add(r.line_no)
    assert got[1] == {9, 10, 15, 16, 18, 21} and got[2] == {4, 6, 9, 14} and set(got) == {1, 2}
    text = {r.page_id: r.text for r in main_content(df).collect()}
    assert text[3] == PAGE and text[4] is None and "Three more" not in text[1] and "kettles" in text[2]
    assert main_lines(df.limit(0)).count() == 0
