"""Queries over addresses, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanspark.functions import urls as U
from gleanspark.operators import pages as P
from gleanspark.session import table

WORDS, YEAR, SEED, SEARCH = ["shop", "archive"], 2026, "https://quillmere.example/", "shop guides"


def _urls(spark, d):
    return table(spark, d, "scrapes").select("url").where("url is not null").distinct()


def _flat(**makers):
    """Columns are made when the query runs, as they need a session."""
    return lambda spark, d: _urls(spark, d).select("url", *[make(F.col("url")).alias(k) for k, make in makers.items()])


def links(spark, d):
    """Links of each html page by its tree: absolute by its base, without fragment, first seen first."""
    p = table(spark, d, "pages").where("content_type = 'html' and html is not null").select("page_id", "url", "html").distinct()
    return P.render(p, ["links"], keys=("page_id", "url")).select("page_id", "url", F.posexplode("links").alias("pos", "link"))


def followed(spark, d):
    return links(spark, d).where(U.child_link(F.col("link"), F.col("url"), exclude=["^/9"])).select("page_id", "link")


def ranked(spark, d):
    """Best links of each page: normalised, followed, scored, the ten best."""
    x = links(spark, d).where(U.child_link(F.col("link"), F.col("url"))).select("page_id", U.crawl_key(F.col("link")).alias("link"), "pos")
    x = x.groupBy("page_id", "link").agg(F.min("pos").alias("pos")).withColumn("score", U.composite_score(F.col("link"), WORDS, YEAR))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("page_id", "link", "score", "rank")


def mapped(spark, d):
    """Discovery: valid addresses of a site, filtered, first seen per key, by relevance, at most 5000."""
    s = table(spark, d, "scrapes").select("url", "scrape_id").where("url is not null")
    s = s.where(U.is_valid(F.col("url")) & U.same_site(F.col("url"), F.lit(SEED)) & ~U.excluded(F.col("url"), ["/prices/"]))
    first = s.groupBy(U.dedup_key(F.col("url")).alias("key")).agg(F.min(F.struct("scrape_id", "url")).alias("x")).select("key", "x.url", "x.scrape_id")
    return first.withColumn("score", U.relevance(F.col("url"), SEARCH)).orderBy(F.desc("score"), "scrape_id").limit(5000).select("key", "url", "score")


def variants(spark, d):
    return _urls(spark, d).select("url", F.explode(U.similar_urls(F.col("url"))).alias("variant"))


def methods(spark, d):
    s = table(spark, d, "scrapes").select(F.col("url")).where("url is not null").withColumn("method", F.lit("scrapes"))
    p = table(spark, d, "pages").select("url").where("url is not null").withColumn("method", F.lit("pages"))
    j = table(spark, d, "crawl_jobs").select("url").where("url is not null").withColumn("method", F.lit("jobs"))
    x = s.unionByName(p).unionByName(j)
    return x.groupBy("method").agg(F.count("*").alias("found"), F.countDistinct(U.dedup_key(F.col("url"))).alias("distinct_keys"))


QUERIES = {
    "url1_crawl_key": _flat(key=lambda u: U.crawl_key(u)),
    "url2_dedup_key": _flat(key=lambda u: U.dedup_key(u)),
    "url3_similar": variants,
    "url5_domain": _flat(domain=lambda u: U.domain(u)),
    "url6_is_file": _flat(is_file=lambda u: U.is_file(u), ending=lambda u: U.ending(u)),
    "url7_valid": _flat(valid=lambda u: U.is_valid(u)),
    "url8_depth": _flat(depth=lambda u: U.depth(u)),
    "url9_registrable": _flat(registrable=lambda u: U.registrable(U.host(u))),
    "url10_same_site": _flat(same=lambda u: U.same_site(u, F.lit(SEED)), same_host=lambda u: U.same_site(u, F.lit(SEED), False)),
    "url11_included": _flat(plain=lambda u: U.included(u, ["shop"]), pattern=lambda u: U.included(u, ["^/(en|kb)/.*o$", "archive"])),
    "url12_excluded": _flat(excluded=lambda u: U.excluded(u, ["utm_", "/shop/"])),
    "url13_relevance": _flat(score=lambda u: U.relevance(u, SEARCH)),
    "url14_followed_links": followed,
    "url19_keywords": _flat(score=lambda u: U.keyword_score(u, WORDS)),
    "url20_depth_score": _flat(score=lambda u: U.depth_score(u)),
    "url21_freshness": _flat(score=lambda u: U.freshness(u, YEAR)),
    "url22_composite": _flat(score=lambda u: U.composite_score(u, WORDS, YEAR, weights=(2, 1, 0.5))),
    "prj11_links": lambda spark, d: links(spark, d).select("page_id", "link", "pos"),
    "tk2_ranked_links": ranked,
    "tk1_map": mapped,
    "ag6_methods": methods,
}


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_PARTS = r"""
WITH u0 AS (SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL),
h0 AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS sch, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:([0-9]*)', 1) AS prt, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) AS pth, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qry FROM u0),
h AS (SELECT url, sch, host, CASE WHEN (sch = 'http' AND prt = '80') OR (sch = 'https' AND prt = '443') THEN '' ELSE prt END AS prt, CASE WHEN host = '' THEN '' WHEN pth = '' THEN '/' ELSE pth END AS path, qry FROM h0)
"""


def _sql(cols, source="h"):
    return f"{_PARTS} SELECT url, {cols} FROM {source}"


_BARE = "CASE WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END"
_PORT = "CASE WHEN prt = '' THEN '' ELSE ':' || prt END"


def _key(drop, ordered):
    kept = f"list_transform(list_filter(string_split(qry, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({_in(drop)})), lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '%20', '+'))"
    if ordered:
        kept = f"list_transform(list_sort(list_transform({kept}, lambda x, i: {{'n': string_split(x, '=')[1], 'i': i, 'x': x}})), lambda s: s.x)"
    q = f"array_to_string({kept}, '&')"
    return f"CASE WHEN host = '' THEN url ELSE sch || '://' || host || {_PORT} || {_BARE} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END END"


_REG = f"""CASE WHEN regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR len(string_split(host, '.')) <= 2 THEN host
 WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_in(U.MULTI_PART_TLDS)}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""
_SEGS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_END = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"
_REL = "CASE WHEN host = '' THEN 0.5 ELSE least((" + " + ".join(f"CASE WHEN contains(lower(path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END), '{t}') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN list_contains(string_split(lower(path), '/'), '{t}') THEN 0.5::DOUBLE ELSE 0 END" for t in SEARCH.split()) + ") / 2, 1.0::DOUBLE) END"
_KW = "((" + " + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN 1.0::DOUBLE ELSE 0 END" for w in WORDS) + ") / 2)"
_DEP = f"(len({_SEGS}) - CASE WHEN lower({_SEGS}[-1]) IN ('index.html', 'index.php') THEN 1 ELSE 0 END)"
_DSC = f"CASE abs({_DEP} - 3) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.333::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE / (1 + abs({_DEP} - 3)) END"
_YR = r"regexp_extract(path, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1)"
_AGE = f"({YEAR} - try_cast({_YR} AS INTEGER))"
_FR = f"CASE WHEN {_YR} = '' THEN 0.5::DOUBLE WHEN {_AGE} < 0 THEN 1.0::DOUBLE " + " ".join(f"WHEN {_AGE} = {k} THEN {v}::DOUBLE" for k, v in enumerate(U.FRESHNESS_SCORES)) + f" ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * {_AGE}) END"

_LINKS = r"""
WITH p AS (SELECT DISTINCT page_id, url, html FROM pages WHERE content_type = 'html' AND html IS NOT NULL),
l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM p),
l1 AS (SELECT page_id, url, pos, regexp_replace(trim(href), '#.*$', '') AS href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)', 1) AS root,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(?:/(?:[^?#]*/)?)?)', 1) AS folder FROM l0),
l2 AS (SELECT page_id, url, pos, CASE WHEN regexp_matches(href, '^(?i:https?)://[^/?#]') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL
  WHEN href LIKE '//%' THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || ':' || href WHEN href LIKE '/%' THEN root || href WHEN href LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || href
  WHEN href = '' THEN regexp_replace(url, '#.*$', '') ELSE CASE WHEN folder LIKE '%/' THEN folder ELSE folder || '/' END || href END AS link FROM l1),
links AS (SELECT page_id, url, link, CAST(row_number() OVER (PARTITION BY page_id, url ORDER BY min(pos)) - 1 AS INTEGER) AS pos FROM l2 WHERE link IS NOT NULL GROUP BY page_id, url, link)
"""
_DOM = r"regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', '')"
_FOLLOW = f"""{_DOM.format('link')} <> '' AND {_DOM.format('link')} = {_DOM.format('url')} AND lower(regexp_extract(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '\\.([^./]*)$', 1)) NOT IN ({_in(U.NON_PAGE_ENDINGS)})"""

SQL = {
    "url1_crawl_key": _sql(_key(U.TRACKING_CRAWL, True) + " AS key"),
    "url2_dedup_key": _sql(_key(U.TRACKING_DEDUP, False) + " AS key"),
    "url3_similar": _PARTS + f""", k AS (SELECT url, sch, host, {_PORT} AS p, {_BARE} AS path, {_key(U.TRACKING_CRAWL, True)} AS n FROM h),
q AS (SELECT *, CASE WHEN contains(n, '?') THEN '?' || string_split(n, '?')[2] ELSE '' END AS qq, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS sl, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS oh FROM k)
SELECT DISTINCT url, unnest([n, sch || '://' || host || p || sl || qq, sch || '://' || oh || p || path || qq, sch || '://' || oh || p || sl || qq,
 CASE sch WHEN 'https' THEN 'http' WHEN 'http' THEN 'https' END || '://' || host || p || path || qq, CASE WHEN NOT contains(path, '.') THEN sch || '://' || host || p || sl || 'index.html' || qq ELSE n END,
 CASE WHEN path LIKE '%/index.html' THEN sch || '://' || host || p || replace(path, '/index.html', '/') || qq ELSE n END]) AS variant FROM q""",
    "url5_domain": _sql(r"regexp_replace(host, '^www\.', '') AS domain"),
    "url6_is_file": _sql(f"{_END} IN ({_in(U.FILE_ENDINGS)}) AS is_file, {_END} AS ending"),
    "url7_valid": _sql("sch IN ('http', 'https') AND length(host) >= 3 AS valid"),
    "url8_depth": _sql(f"CAST(len({_SEGS}) AS INTEGER) AS depth"),
    "url9_registrable": _sql(f"{_REG} AS registrable"),
    "url10_same_site": _sql(f"host <> '' AND {_REG} = 'quillmere.example' AS same, host = 'quillmere.example' AS same_host"),
    "url11_included": _sql("contains(lower(path), 'shop') AND host <> '' AS plain, (regexp_matches(path, '(?i)^/(en|kb)/.*o$') OR contains(lower(path), 'archive')) AND host <> '' AS pattern"),
    "url12_excluded": _sql("(contains(lower(url), 'utm_') OR contains(lower(url), '/shop/')) AND host <> '' AS excluded"),
    "url13_relevance": _sql(f"{_REL} AS score"),
    "url14_followed_links": f"{_LINKS} SELECT page_id, link FROM links WHERE {_FOLLOW} AND NOT regexp_matches(CASE WHEN regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1) END, '^/9')",
    "url19_keywords": _sql(f"{_KW} AS score"),
    "url20_depth_score": _sql(f"{_DSC} AS score"),
    "url21_freshness": _sql(f"{_FR} AS score"),
    "url22_composite": _sql(f"(2.0::DOUBLE * {_KW} + {_DSC} + 0.5::DOUBLE * {_FR}) / 3.5 AS score"),
    "tk2_ranked_links": _LINKS + _PARTS.replace("WITH u0 AS (SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL)", ", u0 AS (SELECT DISTINCT link AS url FROM links)") + f""", k AS (SELECT url AS link, {_key(U.TRACKING_CRAWL, True)} AS key FROM h),
f AS (SELECT page_id, key AS url, min(pos) AS pos FROM links JOIN k USING (link) WHERE {_FOLLOW} GROUP BY ALL), g AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1) AS p FROM f)),
s AS (SELECT page_id, url AS link, pos, ({_KW} + {_DSC} + {_FR}) / 3 AS score FROM g) SELECT page_id, link, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "prj11_links": f"{_LINKS} SELECT page_id, link, pos FROM links",
    "tk1_map": _PARTS.replace("SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL", "SELECT url, min(scrape_id) AS id FROM scrapes WHERE url IS NOT NULL GROUP BY url").replace("SELECT url, ", "SELECT url, id, ", ).replace("SELECT url, id, min(scrape_id) AS id", "SELECT url, min(scrape_id) AS id") + f""",
k AS (SELECT *, {_key(U.TRACKING_DEDUP, False)} AS key FROM h WHERE sch IN ('http', 'https') AND length(host) >= 3 AND {_REG} = 'quillmere.example' AND NOT contains(lower(url), '/prices/')),
f AS (SELECT *, {_REL} AS score FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, url) = 1)
SELECT key, url, score FROM f ORDER BY score DESC, id LIMIT 5000""",
}
