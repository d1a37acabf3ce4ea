import json

import pytest
from pyspark.sql import functions as F

from gleanspark.html import cleaning as C
from gleanspark.operators import discovery as D
from gleanspark.operators import extraction as X
from gleanspark.operators.pages import render

TEXT = "Orlen Lamp Nine is sold for $2,499.50 in the harbour shop; tags are brass, warm and old."


def test_confidence():
    got = X.confidence({"name": "Orlen Lamp Nine", "maker": "Quibbel Foundry", "none": None, "price": 2499.5, "tags": ["brass", "velvet"], "at": {"where": "harbour", "n": 77}, "x": "é"}, TEXT)
    f = got["fields"]
    assert f["name"]["grounded"] and f["price"]["grounded"] and f["at"]["grounded"] and f["x"]["grounded"]
    assert got["suspect"] == ["maker", "tags"] and got["missing"] == ["none"] and f["tags"]["confidence"] == pytest.approx(0.6)
    assert X.confidence([1, {"a": "brass"}, {"a": "zinc"}], TEXT)["overall"] == 0.9 and X.confidence([], TEXT) == X.confidence("x", TEXT) == {"overall": 0.0, "fields": {}, "suspect": [], "missing": []}


def test_json_and_merge():
    assert X.parse_json('```json\n{"a": 1}\n```') == (True, {"a": 1}) and X.parse_json(" [1] ") == (True, [1])
    assert X.parse_json("3")[0] is X.parse_json(None)[0] is X.parse_json("{x")[0] is False
    assert X.merge(["a", "b"]) == "a\n\nb" and X.merge([[1], [], [2]]) == [1, 2] and X.merge([]) is None and X.merge([{"a": 1}, "x"]) == {"a": 1}
    assert X.merge([{"a": "", "b": [1], "c": None}, {"a": "x", "b": [2], "c": 0}, {"a": "y"}]) == {"a": "x", "b": [1, 2], "c": 0}


def test_validation():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"type": "string", "format": "date"}, "maxItems": 2}, "c": {"type": ["null", "boolean"]}}, "additionalProperties": False}
    assert X.validate({"a": "3", "b": ["2024-01-02"], "c": None}, schema) == []
    assert len(X.validate({"a": 1, "b": ["x", "2024-01-02", "y"], "d": 1}, schema)) == 5
    assert X.validate({}, schema) == ["/ must have required property 'a'"] and X.validate(3, None) == [] and X.validate({"a": 2.5}, schema) == ["/a must be integer"]


def test_self_heal():
    wanted = [{"name": "t", "required": True}, {"name": "u", "type": "attribute"}]
    html = "<div class=row><h2>One</h2></div><div class=row><h2>Two</h2></div>"
    good = {"baseSelector": ".row", "fields": [{"name": "t", "selector": "h2", "type": "text"}]}
    bad = {"baseSelector": ".gone", "fields": good["fields"]}
    assert X.self_heal(html, wanted, cached=good)["source"] == "cache" and X.self_heal(html, wanted, provided=good, cached=bad)["source"] == "provided"
    healed = X.self_heal(html, wanted, cached=bad, derive=lambda _: {"baseSelector": " .row ", "fields": [{"name": "t", "selector": "h2", "type": "odd"}, {"name": "zz"}, {"name": "u", "type": "attribute"}]})
    assert healed["source"] == "healed" and healed["healed"] and healed["record_count"] == 2 and healed["schema"]["fields"][1]["attribute"] == "href" and healed["schema"]["fields"][0]["type"] == "text"
    assert X.self_heal(html, wanted, cached=bad)["degraded"] and not X.self_heal(html, wanted)["success"] and not X.self_heal("", wanted)["success"] and X.coerce_schema("x", wanted) is None
    assert X.yield_of([], ["t"]) == {"healthy": False, "record_count": 0, "ratio": 0.0} and X.yield_of([{"a": []}, {"a": {}}], [])["healthy"] is False and X.yield_of([{"a": 1}, {"a": None}], ["a"])["healthy"]


def test_templates_and_reports(spark):
    assert X.resolve_template("{a}/{b}?q={a}", {"a": "red ü", "b": "../x"}) == "red%20%C3%BC/..%2Fx?q=red%20%C3%BC"
    with pytest.raises(ValueError, match="parameter: b"):
        X.resolve_template("{b}", {"b": ""})
    df = spark.createDataFrame([("it's (a) * b~c!", "x"), (None, "x"), ("", None)], "a string, b string")
    url, error = X.resolved("https://h.test/{a}?b={b}", {"a": F.col("a"), "b": F.col("b")})
    assert [tuple(r) for r in df.select(url, error).collect()] == [("https://h.test/it's%20(a)%20*%20b~c!?b=x", None), (None, "missing required URL parameter: a"), (None, "missing required URL parameter: a")]
    text = X.report("u", None, {"names": ["a", "b"], "codeSamples": ["f()"], "rows": [{"k": [1, True]}], "o": {"p": 1}, "none": None}, "late")
    assert "# Extracted Content" in text and "> ⚠️ **Note**: late" in text and "### CodeSamples\n\n#### Example 1\n\n```typescript\nf()" in text and "**K**:\n- 1\n- true\n" in text and "*No data available*" in text and "- a\n- b\n\n" in text


def test_extract_with_a_completer(spark):
    pages = spark.createDataFrame([(1, "u", "t", TEXT), (2, "u", None, None), (3, "u", "t", "\n\n".join(["word " * 900] * 20))], "page_id bigint, url string, title string, content string")
    got = {r.page_id: r for r in X.extract_with(pages, lambda p: '```json\n{"tags": ["brass"]}\n```', {"type": "object"}).collect()}
    assert json.loads(got[1].data) == {"tags": ["brass"]} and got[1].confidence == 0.9 and got[2].data is None and got[3].chunks > 5 and len(json.loads(got[3].data)["tags"]) == got[3].chunks


LONG = "<p>" + "calm words about the old mill " * 20 + "</p>"


def test_cleaning():
    page = f"<body><nav>menu</nav><main class=x onclick=go()><h1>T</h1>{LONG}<div class='ad-top'>buy</div><div style='display: none'>no</div><p data-track=1 class=head-wrap>gone</p></main></body>"
    out = C.clean_html(page)
    assert out.startswith('<div class="main-content-wrapper"><main class="x">') and "menu" not in out and "buy" not in out and ">no<" not in out and "gone" not in out
    dense = f"<body><div><b>{'x ' * 300}</b></div><section><h2>H</h2>short</section></body>"
    assert "<h2>H</h2>" in C.clean_html(dense)
    assert [n.tag for n in C.main_by_density(C.parse(dense))] == ["section"] and C.main_by_headings(C.parse("<p>x</p>")) == []
    box = C.main_by_headings(C.parse("<h1>A</h1><p>a</p><h2>B</h2><p>b</p><p>c</p>"))[0]
    assert box.text() == "AaBbc"
    assert C.clean_html(None) == C.clean_html("") == "" and "plain" in C.clean_html("<p>plain</p>")


def test_links_and_results():
    page = "<a href='/a#x'>A  b</a><a href='/a#x'>again</a><a href='mailto:q@z.test'>m</a><a href='JavaScript:x()'>j</a><a href='/c'> </a>"
    assert C.legacy_links(page, "https://h.test/") == ["https://h.test/a#x", "mailto:q@z.test", "JavaScript:x()", "https://h.test/c"]
    assert C.visible_links(page, "https://h.test/")[-2:] == ["mailto:q@z.test", "https://h.test/c"] and C.labelled_links(page, "https://h.test/") == [{"text": "A b", "url": "https://h.test/a#x"}]
    html = "".join(f"<div class=result><a class=result__a href='{h}'>t{k}</a><p class=result__snippet>s{k}</p></div>" for k, h in enumerate(["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.test%2F%3Fq%3D1&rut=2", "//duckduckgo.com/y.js?ad=1", "https://b.test/", "https://b.test/", ""]))
    assert [(r["url"], r["snippet"], r["position"]) for r in C.search_results(html, 5)] == [("https://a.test/?q=1", "s0", 1), ("https://b.test/", "s2", 2)] and len(C.search_results(html, 1)) == 1 and C.search_results(html, 0) == C.search_results(None, 3) == []
    assert C.sample("<script>x</script><p>y</p>") == "<p>y</p>" and C.text_only("<p> a </p><style>z</style>") == "a"


def test_one_failing_format_leaves_the_others(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "https://h.test/", "<p>hi</p>"), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in render(rows, ["text", "links", "clean_html"]).collect()}
    assert got[1].text == "hi" and got[1].links == [] and got[1].page_error is None and got[2].text is None
    with pytest.raises(ValueError):
        render(rows, ["text", "odd"])


def test_requests_and_limits():
    ok = D.crawl_request({"url": "https://h.test", "limit": 5000, "maxDepth": "x", "maxUrls": -3, "crawlOptions": {"browserPoolSize": 99}})
    assert (ok["limit"], ok["maxDepth"], ok["maxUrls"], ok["crawlOptions"]["browserPoolSize"]) == (1000, 10, 1, 10)
    for bad in ({}, {"url": "ftp://x"}, {"url": "https://h", "includePaths": "x"}, {"url": "https://h", "excludePaths": ["["]}, {"url": "https://h", "includePatterns": ["x"] * 26}, {"url": "https://h", "webhook": 3}):
        with pytest.raises(ValueError):
            D.crawl_request(bad)
    assert [D.result_limit(x) for x in (None, float("nan"), 2.9, 0, -1)] == [10, 10, 2, 0, 0] and D.provider({"serper": " ", "searxng": "u"}) == "searxng" and D.provider({}) == "duckduckgo"
    clock = iter([0, 40, 99, 100, 130])
    d = D.Deadline(100, lambda: next(clock))
    assert d.remaining() == 60 and not d.expired() and d.expired() and d.remaining() == 0
    assert D.within(lambda: 3, 5000, 0) == 3 and D.within(lambda: 3, 0, 0) == 0 and D.within(lambda: 1 / 0, 500, "x") == "x"
    with pytest.raises(ValueError):
        D.provider({}, "serper")
