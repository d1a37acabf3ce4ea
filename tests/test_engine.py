import pytest

from gleanspark.engine import Engine, register

PAGES = [
    (1, "https://h.test/", "<h1>Home</h1><p>The harbour site tells of boats and ropes at length.</p><a href=/a>a</a><a href=/docs>d</a><a href=/x.pdf>f</a><a href=https://z.test/>z</a>", None, "harbour boats"),
    (2, "https://h.test/a", "<h1>Ropes</h1><p>Old ropes were sold here for 12 crowns a yard until the end.</p><a href=/b>b</a>", None, "ropes ropes"),
    (3, "https://h.test/b", "<h1>B</h1>", None, "x"),
    (4, "https://h.test/docs", None, None, None),
    (5, None, "<p>lost</p>", None, None),
]
SCHEMA = "page_id bigint, url string, html string, title string, content string"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(PAGES, SCHEMA), complete=lambda p: '{"name": "ropes", "fields": []}')


def test_scrape_and_batch(engine):
    rows = engine.scrape(["https://h.test/a", "https://h.test/none", "http://127.0.0.1/", "https://h.test/a"], ["text", "links"]).collect()
    assert [(r.url, r.success, r.error) for r in rows] == [("https://h.test/a", True, None), ("https://h.test/none", False, "not found"), ("http://127.0.0.1/", False, "address is not allowed")] and rows[0].links == ["https://h.test/b"]
    assert tuple(engine.batch(["https://h.test/a", "https://h.test/q"])[1].first()) == (2, 1, 1, "completed_with_errors")
    with pytest.raises(ValueError):
        engine.batch([])


def test_crawl_and_discovery(engine):
    found, edges = engine.crawl({"url": "https://h.test/", "maxDepth": 2, "limit": 50}, [(False, "/docs")])
    assert {(r.url, r.depth) for r in found.collect()} == {("https://h.test/", 0), ("https://h.test/a", 1), ("https://h.test/b", 2)} and edges.count() == 2
    assert {r.url for r in engine.discover("https://h.test/").collect()} == {"https://h.test/", "https://h.test/a", "https://h.test/b", "https://h.test/docs", "https://h.test/x.pdf"}
    assert [r.page_id for r in engine.search("ropes").collect()] == [2] and engine.search(" ").count() == 0
    assert tuple(engine.estimate(5000, extraction_=True).first()) == (1000, "http", 1000)


def test_extraction(engine):
    auto = {r.page_id: r for r in engine.extract_auto([{"name": "t", "required": True}]).collect()}
    assert auto[1].error and auto[4].error
    many = {r.page_id: r for r in engine.extract_many({"type": "object", "required": ["name"]}).collect()}
    assert many[2].errors == [] and many[2].confidence == 0.45 and many[4].data is None
    lines = {r.url: r.line for r in engine.llmstxt().collect()}
    assert lines["https://h.test/a"].startswith("- [Ropes](https://h.test/a): Old ropes were sold") and engine.tools().keys() >= {"scrape", "crawl"}


def test_sql_names(spark, engine):
    names = register(spark)
    engine.pages.createOrReplaceTempView("engine_pages")
    got = spark.sql("SELECT page_id, glean_text(html, url) AS t, size(glean_links(html, url)) AS n, glean_chunks(content, 10, 0.1D) AS c FROM engine_pages WHERE page_id IN (2, 4) ORDER BY page_id").collect()
    assert "glean_fit_html" in names and got[0].t.startswith("Ropes") and got[0].n == 1 and got[0].c == ["ropes ropes"] and got[1].t is None
