"""Queries of sources, discovery, joins and crawls, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanspark.functions import guards as G
from gleanspark.functions import text as T
from gleanspark.functions import urls as U
from gleanspark.operators import discovery as D
from gleanspark.operators import pages as P
from gleanspark.operators.store import latest, lifecycle
from gleanspark.plans import urls as PU
from gleanspark.plans.records import _HOST, _O, _PATH, _S, _SITE, _TRIM, _scrapes, ag1_progress
from gleanspark.session import table
from gleanspark.sources import files

SEED = "https://quillmere.example/"


def src1_fetch(spark, d):
    """What a fetch of each page gives: the first title of its source, trimmed; pages without a source fail."""
    p = table(spark, d, "pages").where("url is not null").select("page_id", "url", "html").distinct()
    title = T.js_trim(F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1))
    return p.select("page_id", F.coalesce(title, F.lit("")).alias("title"), F.when(F.col("html").isNull(), "no body").alias("error"))


def src1_status(spark, d):
    """Fetches that failed by their status, as rows with an error."""
    s = _scrapes(spark, d)
    return s.select("scrape_id", F.coalesce("error", F.when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status").cast("string")))).alias("error"))


def src5_kinds(spark, d):
    """Kinds of documents by their first bytes."""
    s = _scrapes(spark, d).where("content is not null")
    body = F.when(F.col("scrape_id") % 4 == 0, F.concat(F.lit("%PDF-1.7 "), "content")).when(F.col("scrape_id") % 4 == 1, F.concat(F.lit("PK\x03\x04"), "content")).otherwise(F.col("content")).cast("binary")
    return s.select("scrape_id", files.kind_of(body).alias("kind"))


def _maps(spark, d):
    """A site map of each site's pages, an index of each site's maps, and a robots file that names it."""
    s = table(spark, d, "scrapes").where("url is not null").select("url", T.site_of(F.col("url")).alias("site"), F.pmod(F.xxhash64("url"), F.lit(3)).alias("n")).where("site is not null").distinct()
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2025-01-0"), (F.length("url") % 9 + 1).cast("string"), F.lit("</lastmod>"), F.when(F.length("url") % 2 == 0, "<priority>0.5</priority>").otherwise(""), F.lit("</url>"))
    at = lambda name: F.concat(F.lit("https://"), "site", F.lit(f"/{name}"))
    leaves = s.groupBy("site", "n").agg(F.concat(F.lit('<urlset xmlns="x">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body")).select(F.concat(F.lit("https://"), "site", F.lit("/map"), F.col("n").cast("string"), F.lit(".xml")).alias("url"), "body")
    index = s.groupBy("site").agg(F.collect_set("n").alias("ns")).select(at("sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("ns", lambda n: F.concat(F.lit("<sitemap><loc>https://"), "site", F.lit("/map"), n.cast("string"), F.lit(".xml</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    robots = s.select("site").distinct().select("site", F.concat(F.lit("User-agent: *\n  SITEMAP: https://"), "site", F.lit("/sitemap.xml\r\nsitemap:nowhere")).alias("body"))
    return leaves.unionByName(index), robots


def src6_sitemaps(spark, d):
    maps, _ = _maps(spark, d)
    return files.sitemap_urls(files.unzipped(maps.select("url", F.col("body").cast("binary").alias("content"))))


def src7_entries(spark, d):
    return files.sitemap_entries(_maps(spark, d)[0])


def src8_sweep(spark, d):
    maps, robots = _maps(spark, d)
    return D.sitemap_sweep(robots.where("site = 'quillmere.example'"), maps, "https://quillmere.example")


def src9_robots(spark, d):
    return files.robots_sitemaps(_maps(spark, d)[1])


def src10_search(spark, d):
    return D.search_pages(_scrapes(spark, d).select("scrape_id", "url", "title", "content"), "headlines archive", 25)


def src11_result_pages(spark, d):
    """Result pages made of the scrapes of each site, read again."""
    s = _scrapes(spark, d).where("url is not null and title is not null").withColumn("site", T.site_of(F.col("url"))).where("site is not null")
    link = F.concat(F.lit("//duckduckgo.com/l/?uddg="), G.encode_component(F.col("url")), F.lit("&rut=1"))
    w = Window.partitionBy("site").orderBy("scrape_id")
    box = F.concat(F.lit('<div class="result"><a class="result__a" href="'), link, F.lit('">'), F.replace("title", F.lit("<"), F.lit("&lt;")), F.lit('</a><a class="result__snippet">'), F.length("title").cast("string"), F.lit("</a></div>"))
    ten = s.withColumn("n", F.row_number().over(w)).where("n <= 12").select("site", "n", box.alias("box"))
    html = ten.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "box"))), lambda x: x["box"]), "").alias("html"), F.lit("").alias("url"))
    return P.render(html, ["search_results"], keys=("site",)).select("site", F.inline("search_results")).select("site", "position", "url", "snippet")


def src12_answers(spark, d):
    """Answers of a search as JSON, made of the first scrapes of each site, read again."""
    s = _scrapes(spark, d).withColumn("site", T.site_of(F.col("url"))).where("site is not null")
    first = s.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("scrape_id"))).where("n <= 15")
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "title", "url", F.col("content_type").alias("content")))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["content"].alias("content"))).alias("results")))
    return D.answer_results(first.groupBy(F.col("site").alias("query")).agg(body.alias("body")), 8)


def src13_calls(spark, d):
    s = _scrapes(spark, d).where("url is not null and crawl_id is not null")
    log = s.select(F.col("crawl_id").alias("page"), F.concat("url", F.when(F.col("scrape_id") % 3 == 0, ".json").when(F.col("scrape_id") % 3 == 1, "/v1/x").otherwise("")).alias("url"), F.lit("GET").alias("method"), F.coalesce("status", F.lit(200)).alias("status"), "content_type", F.when(F.col("scrape_id") % 2 == 0, "xhr").otherwise("document").alias("resource_type"), F.col("scrape_id").alias("ord"))
    return D.json_calls(log, include_other=True)


def src15_guesses(spark, d):
    """Guessed addresses of every site that are known."""
    s = table(spark, d, "scrapes").where("url is not null").select("url")
    sites = s.select(G.origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    pages = s.select(F.regexp_replace(U.crawl_key(F.col("url")), r"^(https?://[^/]+/[^/?]+).*$", "$1").alias("url"))
    return D.known(D.guesses(sites).select("url"), pages)


def jn9_candidates(spark, d):
    """How many addresses are guessed for each site, and the first and last of them."""
    sites = table(spark, d, "scrapes").where("url is not null").select(G.origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    return D.guesses(sites).groupBy("origin").agg(F.count("*").alias("n"), F.min("url").alias("least"), F.max("url").alias("most"))


def cr6_map(spark, d):
    """Discovery of one site by several methods."""
    ordered = lambda df: df.withColumn("ord", F.row_number().over(Window.orderBy("url")))
    near = lambda name: table(spark, d, name).select("url").where(U.same_site(F.col("url"), F.lit(SEED))).distinct()
    maps, robots = _maps(spark, d)
    swept = D.sitemap_sweep(robots.where("site = 'quillmere.example'"), maps, "https://quillmere.example")
    links, _ = D.discovered([("sitemap", ordered(swept)), ("pages", ordered(near("pages"))), ("jobs", ordered(near("crawl_jobs")))], SEED, PU.SEARCH, exclude=["/prices/"])
    return links


def cr7_interleaved(spark, d):
    """Addresses of all hosts in turn, so that each is represented in the first thousand."""
    s = table(spark, d, "scrapes").where("url is not null").groupBy("url").agg(F.min("scrape_id").alias("ord")).select(U.host(F.col("url")).alias("host"), "url", "ord")
    return D.interleaved(s, "host", "ord").limit(1000).select("host", "url")


def cr8_kickoff(spark, d):
    return D.kickoff(SEED, table(spark, d, "scrapes").where("url is not null").select("url").distinct(), spark)


def cr5_levels(spark, d):
    """Levels of a walk over the links of the pages themselves."""
    links = PU.links(spark, d).select("url", "link")
    return D.crawl_fronts(SEED, table(spark, d, "pages").where("url is not null").select("url"), links.unionByName(links.select(F.lit(SEED).alias("url"), F.col("url").alias("link"))), 3, 500)


def jn2_unseen(spark, d):
    """Addresses of jobs of which no variant was scraped: the relation isn't transitive, so all variants are looked up."""
    jobs = table(spark, d, "crawl_jobs").unionByName(table(spark, d, "pages").select("url"), allowMissingColumns=True).where("url is not null").select("url").distinct()
    hit = jobs.select("url", F.explode(U.similar_urls(F.col("url"))).alias("v")).join(table(spark, d, "scrapes").where("url is not null and content_type = 'html'").select(U.crawl_key(F.col("url")).alias("v")).distinct(), "v", "left_semi").select("url").distinct()
    return jobs.join(hit, "url", "left_anti")


def jn5_results(spark, d):
    """Search results with what was scraped of them, in their order; those that failed stay."""
    found = src10_search(spark, d).select("url", "position")
    got = _scrapes(spark, d).groupBy("url").agg(F.max(F.struct("scrape_id", "content", "error")).alias("x"))
    return found.join(got, "url", "left").select("position", "url", F.when(F.col("x.error").isNull(), F.length("x.content")).alias("length"), F.col("x.error").alias("error"))


def jn6_schemas(spark, d):
    """Each address with the cached schema of its site, if there is one."""
    u = table(spark, d, "scrapes").where("url is not null").select("url", T.site_of(F.col("url")).alias("site")).distinct()
    cache = u.where("site is not null and length(site) % 2 = 0").select("site").distinct().withColumn("source", F.lit("cache"))
    return u.join(cache, "site", "left").select("url", F.coalesce("source", F.lit("derived")).alias("source"))


def jn7_completed(spark, d):
    """Completed jobs with the latest scrape of their address in their crawl."""
    jobs = table(spark, d, "crawl_jobs").where("lower(trim(status)) = 'completed' and url is not null").select("crawl_id", "job_id", "url").distinct()
    got = _scrapes(spark, d).groupBy("crawl_id", "url").agg(F.max("scrape_id").alias("scrape_id"))
    return jobs.join(got, ["crawl_id", "url"]).select("crawl_id", "job_id", "scrape_id")


def ag3_finished(spark, d):
    """Finished crawls: kicked off (a first attempt arrived), nothing streaming any more (no job arrived in the last hour), all jobs done."""
    j = table(spark, d, "crawl_jobs")
    newest = j.agg((F.max("received_at") - F.expr("INTERVAL 1 HOUR")).alias("now"))
    gates = j.groupBy("crawl_id").agg(F.bool_or(F.col("attempt") == 1).alias("kicked"), F.max("received_at").alias("last")).join(F.broadcast(newest)).select("crawl_id", "kicked", (F.col("last") > F.col("now")).alias("streaming"))
    return ag1_progress(spark, d).join(gates, "crawl_id").select("crawl_id", "kicked", "streaming", (F.col("kicked") & ~F.col("streaming") & (F.col("done") == F.col("total")) & (F.col("total") > 0)).alias("finished"))


def ag10_index(spark, d):
    """Lines of the index of each site for language models: title, address and description of each page, the first scrape of it."""
    lines = F.filter(F.transform(F.split("content", "\n"), T.js_trim), lambda x: (F.length(x) > 30) & ~x.startswith("#") & ~x.startswith("["))
    s = _scrapes(spark, d).where("error is null and url is not null").withColumn("site", T.site_of(F.col("url"))).where("site is not null")
    first = s.groupBy("site", "url").agg(F.min(F.struct("scrape_id", "title", "content")).alias("x")).select("site", "url", "x.*")
    desc = F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 200)
    line = F.concat(F.lit("- ["), F.coalesce(F.nullif("title", F.lit("")), "url"), F.lit("]("), "url", F.lit(")"), F.when(desc == "", "").otherwise(F.concat(F.lit(": "), desc)))
    w = Window.partitionBy("site").orderBy("scrape_id")
    body = first.select("site", F.row_number().over(w).alias("line_no"), line.alias("line"))
    head = first.groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit(0).alias("line_no"), F.concat(F.lit("# "), "site", F.lit("\n\n> Auto-generated index of "), F.col("n").cast("string"), F.lit(" pages.\n\n## Pages\n")).alias("line"))
    return head.unionByName(body)


def ag11_cache(spark, d):
    """Keys and megabytes of a cache of snapshots, per options."""
    p = table(spark, d, "page_snapshots").select("url", "options_fingerprint", F.octet_length(F.coalesce("content", F.lit(""))).alias("b")).groupBy("url", "options_fingerprint").agg(F.max("b").alias("b"))
    return p.groupBy("options_fingerprint").agg(F.count("*").alias("keys"), F.round(F.sum("b") / 1048576, 2).alias("megabytes"))


def _proxies(spark, d):
    """State of each proxy behind each of its requests: failures in a row, counted again after a cool-down, and when that ends."""
    j = table(spark, d, "crawl_jobs").where("ts is not null").select("job_id", "attempt", "ts", F.lower(F.trim("status")).alias("status")).distinct()
    log = j.select(F.pmod(F.ascii(F.substring("job_id", -1, 1)), F.lit(5)).alias("proxy"), "ts", "job_id", "attempt", "status", (F.col("status") == "completed").alias("ok"))
    return D.proxy_states(log.where("ok is not null"), "proxy", ["ts", "job_id", "attempt", "status"])


def cr16_proxies(spark, d):
    return _proxies(spark, d).select("proxy", "job_id", "attempt", "status", "failures", "cooling_until")


def ag13_pool(spark, d):
    """Proxies that are healthy at the end."""
    last = _proxies(spark, d).groupBy("proxy").agg(F.max(F.struct("ts", "job_id", "attempt", "status", "cooling_until")).alias("x"), F.max("ts").alias("seen"))
    now = last.agg(F.max("seen").alias("now"))
    return last.join(F.broadcast(now)).agg(F.count("*").alias("total"), F.count_if(F.col("x.cooling_until").isNull() | (F.col("x.cooling_until") <= F.col("now"))).alias("healthy"))


def tk3_granted(spark, d):
    """Pages of a budget of 50 that each hour of a crawl is granted, in order."""
    j = table(spark, d, "crawl_jobs").where("ts is not null").select("crawl_id", "job_id", F.date_trunc("hour", "ts").alias("hour")).distinct().groupBy("crawl_id", "hour").agg(F.count("*").alias("want"))
    used = F.coalesce(F.sum("want").over(Window.partitionBy("crawl_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return j.select("crawl_id", "hour", "want", D.granted(F.col("want"), F.least(used, F.lit(50)), F.lit(50)).alias("granted"))


def cr11_estimate(spark, d):
    s = _scrapes(spark, d)
    pages, mode, calls = D.estimate(F.when(F.col("scrape_id") % 5 > 0, F.col("scrape_id") % 3000), F.col("content_type") == "html", F.col("scrape_id") % 2 == 0, F.col("scrape_id") % 4 == 0)
    return s.select("scrape_id", pages.alias("max_pages"), mode.alias("mode"), calls.alias("calls"), D.fingerprint_no(F.col("scrape_id")).alias("profile"))


def cr25_backoff(spark, d):
    """Waits of a browser between attempts without jitter: by a factor of two up to half a minute."""
    j = table(spark, d, "crawl_jobs").where("attempt is not null").select("job_id", "attempt").distinct()
    return j.select("job_id", "attempt", F.least(F.lit(30000.0), F.lit(1000.0) * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("wait_ms"))


def cr9_lifecycle(spark, d):
    """What became of each crawl, seen from the last day of 2025."""
    return lifecycle(table(spark, d, "crawl_jobs"), now=F.lit("2025-12-31").cast("timestamp"))


def ag12_queue(spark, d):
    """Jobs of each crawl by the state of their last attempt."""
    j = table(spark, d, "crawl_jobs").where("ts is not null").select("crawl_id", "job_id", "attempt", F.coalesce(F.lower(F.trim("status")), F.lit("waiting")).alias("status"))
    last = latest(j, ["crawl_id", "job_id"], "attempt")
    return last.groupBy("crawl_id", "status").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (
    cr9_lifecycle, ag12_queue,
    src1_fetch, src1_status, src5_kinds, src6_sitemaps, src7_entries, src8_sweep, src9_robots, src10_search, src11_result_pages, src12_answers, src13_calls, src15_guesses, jn9_candidates, cr6_map, cr7_interleaved, cr8_kickoff, cr5_levels,
    jn2_unseen, jn5_results, jn6_schemas, jn7_completed, ag3_finished, ag10_index, ag11_cache, cr16_proxies, ag13_pool, tk3_granted, cr11_estimate, cr25_backoff)}

_ORIGIN = "CASE WHEN host = '' THEN '' ELSE sch || '://' || host || CASE WHEN prt = '' THEN '' ELSE ':' || prt END END"
_LIST = lambda v: "[" + PU._in(v) + "]"
_GUESS = PU._PARTS + f""", o AS (SELECT DISTINCT {_ORIGIN} AS origin FROM h WHERE host <> ''), c AS (SELECT unnest({_LIST(D.COMMON_PATHS)}) AS path UNION ALL
 SELECT d || n || e FROM (SELECT unnest({_LIST(D.DOCUMENT_PATHS)}) AS d) CROSS JOIN (SELECT unnest({_LIST(D.DOCUMENT_ENDINGS)}) AS e) CROSS JOIN (SELECT unnest({_LIST(D.DOCUMENT_NAMES)}) AS n)
 UNION ALL SELECT '/' || n || e FROM (SELECT unnest({_LIST(D.DOCUMENT_ENDINGS)}) AS e) CROSS JOIN (SELECT unnest({_LIST(D.ROOT_NAMES)}) AS n)), g AS (SELECT origin, origin || path AS url FROM o CROSS JOIN c)
"""
_VALID = "sch IN ('http', 'https') AND length(host) >= 3"
_SITED = PU._PARTS + f", u AS (SELECT url, {_SITE} AS site FROM u0), v AS (SELECT url FROM u JOIN h USING (url) WHERE site IS NOT NULL AND {_VALID})"
_NT = lambda c, t: f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"
_SEARCH = _S + ", f AS (SELECT scrape_id, url, title, " + " + ".join(f"3 * {_NT('lower(coalesce(title, chr(32)))', t)} + {_NT('lower(coalesce(content, chr(32)))', t)}" for t in ("headlines", "archive")) + " AS score FROM s WHERE url IS NOT NULL), b AS (SELECT * FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, scrape_id) = 1), r AS (SELECT scrape_id, url, title, row_number() OVER (ORDER BY score DESC, scrape_id) AS position FROM b QUALIFY position <= 25)\n"
_PROXY = """WITH l AS (SELECT DISTINCT ascii(right(job_id, 1)) % 5 AS proxy, ts, job_id, attempt, lower(trim(status)) AS status, lower(trim(status)) = 'completed' AS ok FROM crawl_jobs WHERE ts IS NOT NULL AND status IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY proxy ORDER BY ts, job_id, attempt, status ROWS UNBOUNDED PRECEDING) AS grp FROM l),
n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY proxy, grp ORDER BY ts, job_id, attempt, status ROWS UNBOUNDED PRECEDING) AS k FROM g),
p AS (SELECT *, CAST(k % 3 AS INTEGER) AS failures, max(CASE WHEN k > 0 AND k % 3 = 0 AND NOT ok THEN ts + INTERVAL 1 MINUTE END) OVER (PARTITION BY proxy, grp ORDER BY ts, job_id, attempt, status ROWS UNBOUNDED PRECEDING) AS cooling_until FROM n)
"""
SQL = {
    "cr9_lifecycle": "WITH g AS (SELECT crawl_id, min(ts) AS created_at, max(ts) AS last_at, bool_or(lower(trim(status)) IN ('cancelled', 'canceled')) AS c, count(DISTINCT job_id) AS n, count(DISTINCT CASE WHEN lower(trim(status)) IN ('completed', 'failed') THEN job_id END) AS d FROM crawl_jobs GROUP BY crawl_id) SELECT crawl_id, created_at, last_at, CASE WHEN coalesce(c, false) THEN 'cancelled' WHEN d = n THEN 'done' WHEN last_at < TIMESTAMP '2025-12-31' - INTERVAL 24 HOUR THEN 'expired' ELSE 'active' END AS state FROM g",
    "ag12_queue": "WITH j AS (SELECT DISTINCT crawl_id, job_id, attempt, coalesce(lower(trim(status)), 'waiting') AS status FROM crawl_jobs WHERE ts IS NOT NULL), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY crawl_id, job_id ORDER BY attempt DESC NULLS LAST, status DESC) = 1) SELECT crawl_id, status, count(*) AS jobs FROM l GROUP BY ALL",
    "src1_fetch": f"SELECT page_id, coalesce({_TRIM.format(chr(34) + 't' + chr(34))}, '') AS title, CASE WHEN html IS NULL THEN 'no body' END AS error FROM (SELECT DISTINCT page_id, html, regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1) AS t, url FROM pages WHERE url IS NOT NULL)",
    "src1_status": _S + "SELECT scrape_id, coalesce(error, CASE WHEN status >= 400 THEN 'status ' || status END) AS error FROM s",
    "src5_kinds": _S + "SELECT scrape_id, CASE scrape_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE CASE WHEN starts_with(lower(content), '%pdf-') THEN 'pdf' WHEN starts_with(lower(content), 'pk') THEN 'docx' ELSE 'html' END END AS kind FROM s WHERE content IS NOT NULL",
    "src6_sitemaps": _SITED + "SELECT DISTINCT url FROM v",
    "src7_entries": _SITED + "SELECT url, '2025-01-0' || (length(url) % 9 + 1) AS lastmod, NULL::VARCHAR AS changefreq, CASE WHEN length(url) % 2 = 0 THEN 0.5::DOUBLE END AS priority FROM v",
    "src8_sweep": PU._PARTS + f", u AS (SELECT url, {_SITE} AS site FROM u0), k AS (SELECT h.*, {PU._key(U.TRACKING_DEDUP, False)} AS key FROM h JOIN u USING (url) WHERE site = 'quillmere.example' AND {_VALID}) SELECT min(url) AS url FROM k GROUP BY key ORDER BY url LIMIT 5000",
    "src9_robots": f"SELECT DISTINCT 'https://' || site || '/sitemap.xml' AS url FROM (SELECT {_SITE} AS site FROM scrapes WHERE url IS NOT NULL) WHERE site IS NOT NULL",
    "src10_search": _SEARCH + "SELECT scrape_id, url, title, position FROM r",
    "jn5_results": _SEARCH + ", g AS (SELECT DISTINCT ON (url) url, content, error FROM s ORDER BY url, scrape_id DESC) SELECT position, r.url, CASE WHEN error IS NULL THEN length(content) END AS length, error FROM r LEFT JOIN g ON r.url = g.url",
    "src11_result_pages": _S + f", t AS (SELECT *, {_SITE} AS site FROM s WHERE url IS NOT NULL AND title IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY scrape_id) AS n FROM t WHERE site IS NOT NULL QUALIFY n <= 12), o AS (SELECT site, url, min(n) AS n, arg_min(length(title), n) AS l FROM n GROUP BY site, url) SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY n) AS INTEGER) AS position, url, CAST(l AS VARCHAR) AS snippet FROM o QUALIFY position <= 10",
    "src12_answers": _S + f", t AS (SELECT *, {_SITE} AS site FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY scrape_id) AS n FROM t WHERE site IS NOT NULL QUALIFY n <= 15), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY site, trim(url, ' ') ORDER BY n) = 1) SELECT site AS query, trim(coalesce(title, ''), ' ') AS title, trim(url, ' ') AS url, trim(coalesce(content_type, ''), ' ') AS snippet, CAST(row_number() OVER (PARTITION BY site ORDER BY n) AS INTEGER) AS position FROM o QUALIFY position <= 8",
    "src13_calls": _S + """, l AS (SELECT crawl_id AS page, url || CASE scrape_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '/v1/x' ELSE '' END AS url, 'GET' AS method, coalesce(status, 200) AS status, content_type, CASE WHEN scrape_id % 2 = 0 THEN 'xhr' ELSE 'document' END AS resource_type, scrape_id AS ord FROM s WHERE url IS NOT NULL AND crawl_id IS NOT NULL),
j AS (SELECT *, contains(lower(coalesce(content_type, '')), 'application/json') OR contains(lower(coalesce(content_type, '')), '+json') OR contains(lower(coalesce(content_type, '')), 'graphql') OR regexp_matches(url, '(?i)/(api|graphql|gql|v[0-9]+)(/|\\?|$)') OR regexp_matches(url, '(?i)\\.json(\\?|$)') AS is_json FROM l WHERE status < 400),
f AS (SELECT * FROM j WHERE is_json OR resource_type = 'xhr' QUALIFY row_number() OVER (PARTITION BY page, method, url ORDER BY ord) = 1), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY ord) <= 50)
SELECT page, method, url, status, content_type, resource_type, is_json, CAST(row_number() OVER (PARTITION BY page ORDER BY is_json DESC, ord) AS INTEGER) AS position FROM c""",
    "src15_guesses": _GUESS + f", k AS (SELECT regexp_replace({PU._key(U.TRACKING_CRAWL, True)}, '^(https?://[^/]+/[^/?]+).*$', '\\1') AS k FROM h) SELECT url FROM g WHERE url IN (SELECT k FROM k)",
    "jn9_candidates": _GUESS + "SELECT origin, count(*) AS n, min(url) AS least, max(url) AS most FROM g GROUP BY origin",
    "cr7_interleaved": f"WITH u AS (SELECT url, min(scrape_id) AS ord, {_HOST} AS host FROM scrapes WHERE url IS NOT NULL GROUP BY url), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ord) AS n FROM u) SELECT host, url FROM n ORDER BY n, host LIMIT 1000",
    "cr8_kickoff": PU._PARTS + f", k AS (SELECT url, {PU._key(U.TRACKING_CRAWL, True)} AS key FROM h WHERE host <> ''), a AS (SELECT url, key, 15 AS priority FROM k UNION ALL SELECT '{SEED}', '{SEED}', 5) SELECT url, CAST(priority AS INTEGER) AS priority FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, url) = 1",
    "jn2_unseen": PU._PARTS.replace("SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL", "SELECT DISTINCT url FROM (SELECT url FROM scrapes UNION SELECT url FROM pages UNION SELECT url FROM crawl_jobs) WHERE url IS NOT NULL") + f""", k AS (SELECT url, sch, host, {PU._PORT} AS p, {PU._BARE} AS path, {PU._key(U.TRACKING_CRAWL, True)} AS n FROM h),
q AS (SELECT *, CASE WHEN contains(n, '?') THEN '?' || string_split(n, '?')[2] ELSE '' END AS qq, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS sl, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS oh FROM k),
v AS (SELECT url, unnest([n, sch || '://' || host || p || sl || qq, sch || '://' || oh || p || path || qq, sch || '://' || oh || p || sl || qq, CASE sch WHEN 'https' THEN 'http' WHEN 'http' THEN 'https' END || '://' || host || p || path || qq,
 CASE WHEN NOT contains(path, '.') THEN sch || '://' || host || p || sl || 'index.html' || qq ELSE n END, CASE WHEN path LIKE '%/index.html' THEN sch || '://' || host || p || replace(path, '/index.html', '/') || qq ELSE n END]) AS variant FROM q),
s AS (SELECT n FROM k WHERE url IN (SELECT url FROM scrapes WHERE url IS NOT NULL AND content_type = 'html')) SELECT DISTINCT url FROM v WHERE url IN (SELECT url FROM crawl_jobs UNION SELECT url FROM pages) AND url NOT IN (SELECT url FROM v WHERE variant IN (SELECT n FROM s))""",
    "jn6_schemas": f"WITH u AS (SELECT DISTINCT url, {_SITE} AS site FROM scrapes WHERE url IS NOT NULL) SELECT url, CASE WHEN site IS NOT NULL AND length(site) % 2 = 0 THEN 'cache' ELSE 'derived' END AS source FROM u",
    "jn7_completed": "WITH j AS (SELECT DISTINCT crawl_id, job_id, url FROM crawl_jobs WHERE lower(trim(status)) = 'completed' AND url IS NOT NULL) SELECT crawl_id, job_id, max(scrape_id) AS scrape_id FROM j JOIN scrapes USING (crawl_id, url) GROUP BY crawl_id, job_id, url",
    "ag3_finished": _O + ", t AS (SELECT crawl_id, bool_or(attempt = 1) AS kicked, max(received_at) > (SELECT max(received_at) - INTERVAL 1 HOUR FROM crawl_jobs) AS streaming FROM crawl_jobs GROUP BY crawl_id) SELECT crawl_id, kicked, streaming, kicked AND NOT streaming AND done = total AND total > 0 AS finished FROM g JOIN t USING (crawl_id)",
    "ag10_index": _S + f""", t AS (SELECT *, {_SITE} AS site FROM s WHERE error IS NULL AND url IS NOT NULL), f AS (SELECT * FROM t WHERE site IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY scrape_id) = 1),
x AS (SELECT *, left(coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: length(l) > 30 AND NOT starts_with(l, '#') AND NOT starts_with(l, '['))[1], ''), 200) AS descr FROM f)
SELECT site, 0 AS line_no, '# ' || site || chr(10) || chr(10) || '> Auto-generated index of ' || count(*) || ' pages.' || chr(10) || chr(10) || '## Pages' || chr(10) AS line FROM f GROUP BY site
UNION ALL SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY scrape_id) AS INTEGER), '- [' || coalesce(nullif(title, ''), url) || '](' || url || ')' || CASE WHEN descr = '' THEN '' ELSE ': ' || descr END FROM x""",
    "ag11_cache": "WITH p AS (SELECT url, options_fingerprint, max(strlen(coalesce(content, ''))) AS b FROM page_snapshots GROUP BY ALL) SELECT options_fingerprint, count(*) AS keys, round(sum(b) / 1048576.0::DOUBLE, 2) AS megabytes FROM p GROUP BY ALL",
    "cr16_proxies": _PROXY + "SELECT proxy, job_id, attempt, status, failures, cooling_until FROM p",
    "ag13_pool": _PROXY + ", e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY proxy ORDER BY ts DESC, job_id DESC, attempt DESC, status DESC) = 1) SELECT count(*) AS total, count(*) FILTER (cooling_until IS NULL OR cooling_until <= (SELECT max(ts) FROM l)) AS healthy FROM e",
    "tk3_granted": "WITH j AS (SELECT crawl_id, date_trunc('hour', ts) AS hour, count(DISTINCT job_id) AS want FROM crawl_jobs WHERE ts IS NOT NULL GROUP BY ALL), u AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY crawl_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM j) SELECT crawl_id, hour, want, CAST(greatest(0, least(want, 50 - least(used, 50))) AS BIGINT) AS granted FROM u",
    "cr11_estimate": _S + "SELECT scrape_id, least(coalesce(CASE WHEN scrape_id % 5 > 0 THEN scrape_id % 3000 END, 100), 1000) AS max_pages, CASE WHEN content_type = 'html' THEN 'browser' ELSE 'http' END AS mode, CASE WHEN scrape_id % 2 = 0 AND scrape_id % 4 <> 0 THEN least(coalesce(CASE WHEN scrape_id % 5 > 0 THEN scrape_id % 3000 END, 100), 1000) ELSE 0 END AS calls, scrape_id % 3 AS profile FROM s",
    "cr25_backoff": "SELECT DISTINCT job_id, attempt, least(30000.0::DOUBLE, 1000.0::DOUBLE * power(2.0::DOUBLE, attempt - 1)) AS wait_ms FROM crawl_jobs WHERE attempt IS NOT NULL",
    "ag6_methods": PU._PARTS.replace("SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL", "SELECT DISTINCT url FROM (SELECT url FROM scrapes UNION ALL SELECT url FROM pages UNION ALL SELECT url FROM crawl_jobs) WHERE url IS NOT NULL") + f", k AS (SELECT url, {PU._key(U.TRACKING_DEDUP, False)} AS key FROM h), a AS (SELECT url, 'scrapes' AS method FROM scrapes UNION ALL SELECT url, 'pages' FROM pages UNION ALL SELECT url, 'jobs' FROM crawl_jobs) SELECT method, count(*) AS found, count(DISTINCT key) AS distinct_keys FROM a JOIN k USING (url) GROUP BY method",
}
