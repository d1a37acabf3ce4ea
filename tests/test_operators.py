import zipfile
from io import BytesIO

from gleanspark.operators.chunker import chunk, tokens
from gleanspark.operators.crawl import crawl, robots_allow, robots_rules
from gleanspark.sources import files as S


def test_chunks():
    paras = "\n\n".join("one two three four" for _ in range(12))
    a, b = chunk(paras, 30, 0.1), chunk(paras, 30, 0)
    assert len(a) >= len(b) > 1 and all(tokens(x) <= 30 for x in a + b)
    assert a[0].split("\n\n")[-1] == a[1].split("\n\n")[0]
    code = "intro\n\n```\n" + "x y z\n" * 40 + "\n# no\n```\n\nend"
    assert any(c.startswith("```") and c.endswith("```") and c.count("x y z") == 40 for c in chunk(code, 20, 0))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| r{k} | v |" for k in range(40))
    parts = chunk(table, 60, 0)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in parts) and sum(p.count("| r") for p in parts) == 40
    long = " ".join(f"w{k}" for k in range(200))
    assert " ".join(chunk(long, 40, 0)) == long
    assert chunk(None) == chunk(" \n") == [] and chunk(" x ") == ["x"] and chunk("a b", -1, float("nan")) == ["a b"]


def test_crawl(spark):
    e = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "shop"), ("d", "e"), ("e", "f"), (None, "x")]
    links = spark.createDataFrame([(x and f"https://s.test/{x}", f"https://s.test/{y}/") for x, y in e], "url string, link string")
    seeds = spark.createDataFrame([("https://s.test/a#top",)], "url string")
    name = lambda df: {(r.url.rsplit("/", 1)[1], r.depth) for r in df.collect()}
    assert name(crawl(links, seeds, depth=3)) == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("shop", 2), ("e", 3)}
    assert name(crawl(links, seeds, depth=5, budget=4, words=("shop",))) == {("a", 0), ("b", 1), ("c", 1), ("shop", 2)}
    assert crawl(links, seeds.limit(0)).count() == 0


def test_robots():
    r = robots_rules("User-agent: *\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\n\nUser-agent: gleaner\nDisallow:\n", "other")
    assert [robots_allow(r, p) for p in ("/", "/p/x", "/p/ok/1", "/a.pdf", "/a.pdfx")] == [True, False, True, False, True]
    assert robots_allow(robots_rules("User-agent: *\nDisallow: /\n\nUser-agent: gleaner\nDisallow:\n", "Gleaner/1"), "/x") and robots_allow(robots_rules(None), "/x")


def test_files(spark):
    buf = BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>')
    df = spark.createDataFrame([("a", bytearray(b"%PDF-1")), ("b", bytearray(buf.getvalue())), ("c", bytearray(b"<h1>T</h1>")), ("d", bytearray(b"PKbroken")), ("e", None)], "path string, content binary")
    got = {r.path: r for r in S.documents(df).collect()}
    assert got["a"].error and got["b"].text == "one\n\ntwo" and got["c"].text == "# T" and got["d"].kind == "docx" and got["d"].error and "e" not in got


def test_sitemaps(spark):
    maps = [("https://s.test/i.xml", "<sitemapindex><sitemap><loc>https://s.test/a.xml</loc></sitemap><sitemap><loc>https://s.test/j.xml</loc></sitemap></sitemapindex>"), ("https://s.test/j.xml", "<sitemapindex><loc>https://s.test/j.xml</loc><loc>https://s.test/t.txt</loc></sitemapindex>"), ("https://s.test/a.xml", "<urlset xmlns='x'><url><loc> https://s.test/1?a=1&amp;b=2 </loc></url><url><loc>ftp://no</loc></url></urlset>"), ("https://s.test/t.txt", "https://s.test/2\n\nbad"), ("https://s.test/n.xml", None)]
    assert {r.url for r in S.sitemap_urls(spark.createDataFrame(maps, "url string, body string")).collect()} == {"https://s.test/1?a=1&b=2", "https://s.test/2"}
    assert [r.url for r in S.robots_sitemaps(spark.createDataFrame([("User-agent: *\n SITEMAP: https://s.test/i.xml\r\nSitemap: no",)], "body string")).collect()] == ["https://s.test/i.xml"]


def test_metrics(spark):
    df = spark.createDataFrame([("hits", {"b": 'q"', "a": "1"}, 2), ("hits", {"a": "1", "b": 'q"'}, 3), ("up", {}, 1)], "name string, labels map<string,string>, value bigint")
    assert {r.line for r in S.metrics_text(df).collect()} == {'hits{a="1",b="q\\""} 5', "up 1"}
    assert S.slug("a_1") and not S.slug("a_1\n") and not S.slug("A")
