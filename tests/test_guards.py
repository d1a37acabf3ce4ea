import gzip

from pyspark.sql import functions as F

from gleanspark.functions import guards as G
from gleanspark.operators import discovery as D
from gleanspark.operators.crawl import robots_allow, robots_rules
from gleanspark.sources import exports as X
from gleanspark.sources import files as S


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("n", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("n").select(make(F.col("v"))).collect()]


def test_blocked_addresses(spark):
    bad = ["http://127.0.0.1/", "https://10.1.2.3:8/x", "http://169.254.169.254/latest", "http://100.64.0.1", "http://0.0.0.0/", "http://[::1]/", "http://[fc00::1]/", "http://[2001:db8::1]/", "http://[2002:7f00:1::]/", "http://224.0.0.1/"]
    good = ["http://8.8.8.8/", "https://h.test/", "data:text/plain,x", "http://[2a00:1450::1]/", "x", "http://172.32.0.1/"]
    assert one(spark, G.blocked_request, *bad, *good) == [True] * len(bad) + [False] * len(good)
    assert one(spark, G.is_safe_name, "http://localhost/", "http://172.20.1.1/", "http://h.test/", "ftp://h.test/", None, "x") == [False, False, True, False, False, False]


def test_robots_as_a_column(spark):
    rules = robots_rules("User-agent: *\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\nDisallow: /a(b\nAllow: /x\nDisallow: /x\n")
    paths = ["/", "/p/x", "/p/ok/1", "/a.pdf", "/a.pdfx", "/a(bc", "/x", "/q?p=1"]
    assert one(spark, lambda c: G.allowed_by(c, rules), *[f"https://h.test{p}" for p in paths]) == [robots_allow(rules, p) for p in paths]


def test_scores_and_tokens(spark):
    assert one(spark, G.legacy_score, "https://h.test/", "https://h.test/docs/a?x=1", "https://h.test/login/about", "no") == [0, -3, -30, -100]
    assert one(spark, G.cache_token, "HTTPS://H.test/a b//", "x y") == ["https%3A%2F%2Fh.test%2Fa%20b", "x%20y"]
    assert one(spark, lambda c: G.crawlable(c, "https://h.test/docs", 2, exclude=["", "secret"]), "https://h.test/docs/a", "https://h.test/docs/a/b", "https://h.test/x", "https://h.test/docs/secret", "https://h.test/docs/a.pdf") == [True, False, False, False, False]
    assert one(spark, lambda c: G.discoverable(c, F.lit("https://h.test:443/")), "https://h.test/a", "http://h.test/a", "https://h.test:8/a") == [True, False, False]
    df = spark.createDataFrame([(5, 48), (5, 50), (0, 3), (5, 60)], "want int, used int")
    assert [r[0] for r in df.select(D.granted(F.col("want"), F.col("used"), F.lit(50))).collect()] == [2, 0, 0, 0]


def test_proxies_cool_down(spark):
    log = spark.createDataFrame([("a", k, ok) for k, ok in enumerate([False, False, True, False, False, False, False, True])] + [("b", 0, True)], "proxy string, n int, ok boolean")
    rows = D.proxy_states(log.withColumn("ts", F.timestamp_seconds(F.col("n"))), "proxy", ["n"]).where("proxy = 'a'").orderBy("n").collect()
    assert [r.failures for r in rows] == [1, 2, 0, 1, 2, 0, 1, 0] and [r.cooling_until is not None for r in rows] == [False] * 5 + [True, True, False]
    assert [r.proxy for r in D.round_robin(log.drop("proxy"), ["n"], ["x", "y"]).orderBy("n").limit(1).collect()] == ["x"]


def test_packed_maps_and_cycles(spark):
    maps = [("https://s.test/i.xml", gzip.compress(b"<sitemapindex><loc>https://s.test/j.xml</loc></sitemapindex>")), ("https://s.test/j.xml", b"<sitemapindex><loc>https://s.test/i.xml</loc><loc>https://s.test/a.xml</loc></sitemapindex>"), ("https://s.test/a.xml", b"<urlset><url><loc>https://s.test/1</loc><priority>0.8</priority></url><url><loc>bad</loc></url></urlset>"), ("https://s.test/b.xml", b"\x1f\x8bbroken"), ("https://s.test/c.xml", None)]
    body = S.unzipped(spark.createDataFrame([(u, None if b is None else bytearray(b)) for u, b in maps], "url string, content binary"))
    starts = spark.createDataFrame([("https://s.test/i.xml",)], "url string")
    assert [r.url for r in S.sitemap_urls(body, starts=starts).collect()] == ["https://s.test/1"] and S.sitemap_urls(body, depth=2, starts=starts).count() == 0
    assert [tuple(r) for r in S.sitemap_entries(body).collect()] == [("https://s.test/1", None, None, 0.8)]


def test_histogram_lines(spark):
    seen = spark.createDataFrame([("t", {"q": 'a"b'}, v) for v in (0.03, 0.4, 7.0)], "name string, labels map<string,string>, value double")
    lines = {r.line for r in S.metrics(observed=seen, buckets=(0.1, 1, 10)).collect()}
    assert lines == {"# TYPE t histogram", 't_bucket{q="a\\"b",le="0.1"} 1', 't_bucket{q="a\\"b",le="1"} 2', 't_bucket{q="a\\"b",le="10"} 3', 't_bucket{q="a\\"b",le="+Inf"} 3', 't_sum{q="a\\"b"} 7.43', 't_count{q="a\\"b"} 3'}


def test_front_matter_and_archives(spark):
    texts = ['---\ntitle: "A: b"\ntitle: C\nbad-key: x\nn: 1\nn: 2\n---\nbody\n---', "---\n---\nx", "---\nno end", "plain", "", None]
    meta = lambda c: X.parsed_matter(c)[0]
    assert one(spark, meta, *texts)[:2] == [{"title": "C", "n": "2"}, {}]
    assert one(spark, lambda c: X.parsed_matter(c)[1], *texts)[0] == "A: b" and one(spark, lambda c: X.parsed_matter(c)[2], *texts) == ["body\n---", "x", "---\nno end", "plain", "", None]
    pages = spark.createDataFrame([("c", k, f"https://h.test/{k}?q=ü", None, f"text {k}") for k in range(3)] + [("c", 9, None, "t", None)], "crawl_id string, scrape_id bigint, url string, title string, content string")
    import io
    import json
    import zipfile

    row = X.archives(pages).collect()[0]
    z = zipfile.ZipFile(io.BytesIO(bytes(row.data)))
    manifest = json.loads(z.read("manifest.json"))
    assert row.pages == 4 and manifest["count"] == 4 and manifest["pages"][0]["file"] == "0000_h_test_0_q.md" and z.read("0001_h_test_1_q.md") == b"text 1" and manifest["pages"][3]["file"] == "0003_page.md"
