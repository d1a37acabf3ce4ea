"""Queries over what may be asked for or kept, and SQL that says the same."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from gleanspark.functions import guards as G
from gleanspark.functions import urls as U
from gleanspark.operators.crawl import robots_rules
from gleanspark.plans.urls import _BARE, _END, _KW, _PARTS, _PORT, _SEGS, _in, _key, _sql, _urls
from gleanspark.session import table

SEED, ROBOTS = "https://quillmere.example/news", "User-agent: *\nDisallow: /shop/\nAllow: /shop/public\nDisallow: /*.html$\nDisallow: /archive\nAllow: /archive/2025\n"
RULES = robots_rules(ROBOTS, "gleaner/1.0")


def url4_similar(spark, d):
    """Whether the plain http form without query may name the same page."""
    u = F.col("url")
    plain = F.concat(F.lit("http://"), U.host(u), F.when(U.port(u) == "", "").otherwise(F.concat(F.lit(":"), U.port(u))), U.path(u))
    return _urls(spark, d).where(U.host(u) != "").select("url", U.are_similar(u, plain).alias("similar"))


def url6_legacy_files(spark, d):
    return _urls(spark, d).select("url", G.is_legacy_file(F.col("url")).alias("is_file"), U.ending(F.col("url")).isin(U.NON_PAGE_ENDINGS).alias("no_page"))


def url7_safe_names(spark, d):
    return _urls(spark, d).select("url", G.is_safe_name(F.col("url")).alias("safe"))


def url8_page_depth(spark, d):
    u = F.col("url")
    last = F.lower(F.try_element_at(U.segments(u), F.lit(-1)))
    return _urls(spark, d).select("url", U.depth(u).alias("depth"), (U.depth(u) - F.when(last.isin("index.html", "index.php"), 1).otherwise(0)).alias("page_depth"))


def url15_crawlable(spark, d):
    return _urls(spark, d).select("url", G.crawlable(F.col("url"), SEED, 3, include=["^/[a-z]"], exclude=["/prices"]).alias("below"), G.crawlable(F.col("url"), SEED, 2, exclude=["utm_"], backward=True, whole=True).alias("anywhere"))


def url16_discoverable(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", G.discoverable(u, F.lit(SEED), include=["^/"], exclude=["\\.html$"], domains=["shop."]).alias("discoverable"), G.worth_visiting(u).alias("worth_visiting"))


def url17_robots(spark, d):
    """Addresses that a robots file allows, one column for all of its rules."""
    return _urls(spark, d).select("url", G.allowed_by(F.col("url"), RULES).alias("allowed"))


def _literals(spark, d):
    """An address of each scrape's number, scattered over all of IPv4."""
    n = (F.col("scrape_id") * 2654435761) % 4294967296
    octets = [F.floor(n / (1 << s)).cast("bigint") % 256 for s in (24, 16, 8, 0)]
    return table(spark, d, "scrapes").select("scrape_id").distinct().select(F.concat(F.lit("http://"), F.concat_ws(".", *[o.cast("string") for o in octets]), F.lit("/x")).alias("url"))


def url18_blocked(spark, d):
    return _literals(spark, d).select("url", G.blocked_request(F.col("url")).alias("blocked"))


def url23_legacy_score(spark, d):
    return _urls(spark, d).select("url", G.legacy_score(F.col("url")).alias("score"))


def url24_cache_token(spark, d):
    return _urls(spark, d).select("url", G.cache_token(F.col("url")).alias("token"))


def url25_blocked(spark, d):
    u = F.col("url")
    kind = F.when(U.ending(u).isin("png", "jpg"), "image").when(U.ending(u) == "css", "stylesheet").otherwise("document")
    return _urls(spark, d).select("url", G.blocked_resource(u, kind).alias("blocked"), G.is_tracker(u).alias("tracker"))


QUERIES = {f.__name__: f for f in (url4_similar, url6_legacy_files, url7_safe_names, url8_page_depth, url15_crawlable, url16_discoverable, url17_robots, url18_blocked, url23_legacy_score, url24_cache_token, url25_blocked)}

_KEYED = _PARTS + f", w AS (SELECT *, {_key(U.TRACKING_CRAWL, True)} AS k, {_BARE} AS bare, len({_SEGS}) AS n FROM h)"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_FILE = "regexp_matches(lower(bare), '\\.(" + "|".join(G.LEGACY_FILE_ENDINGS) + ")$')"
_PQ = "path || CASE WHEN qry = '' THEN '' ELSE '?' || qry END"
_LOWQ = "lower(CASE WHEN qry = '' THEN '' ELSE '?' || qry END)"
_SPECIAL = " OR ".join(f"n BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in map(ipaddress.ip_network, G.SPECIAL))
_TOKEN = "CASE WHEN host = '' THEN url ELSE sch || '://' || host || regexp_replace(path, '/+$', '') END"


def _component(c):
    """DuckDB's url_encode leaves -_.~ and encodes the rest, with %20 for blanks."""
    for have, want in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        c = f"replace({c}, '{have}', '{want}')"
    return c


SQL = {
    "url4_similar": _PARTS + f""", k AS (SELECT url, sch, host, {_PORT} AS p, {_BARE} AS path, {_key(U.TRACKING_CRAWL, True)} AS n FROM h WHERE host <> ''),
q AS (SELECT *, CASE WHEN contains(n, '?') THEN '?' || string_split(n, '?')[2] ELSE '' END AS qq, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS sl, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS oh FROM k)
SELECT url, list_contains([n, sch || '://' || host || p || sl || qq, sch || '://' || oh || p || path || qq, sch || '://' || oh || p || sl || qq,
 coalesce(CASE sch WHEN 'https' THEN 'http' WHEN 'http' THEN 'https' END || '://' || host || p || path || qq, n), CASE WHEN NOT contains(path, '.') THEN sch || '://' || host || p || sl || 'index.html' || qq ELSE n END,
 CASE WHEN path LIKE '%/index.html' THEN sch || '://' || host || p || replace(path, '/index.html', '/') || qq ELSE n END], 'http://' || host || CASE WHEN p = ':80' THEN '' ELSE p END || path) AS similar FROM q""",
    "url6_legacy_files": _sql("regexp_matches(lower(path), '\\.(" + "|".join(G.LEGACY_FILE_ENDINGS) + f")$') AS is_file, {_END} IN ({_in(U.NON_PAGE_ENDINGS)}) AS no_page"),
    "url7_safe_names": _sql(f"sch IN ('http', 'https') AND host <> '' AND NOT regexp_matches(host, '{G.PRIVATE_NAMES}') AS safe"),
    "url8_page_depth": _sql(f"CAST(len({_SEGS}) AS INTEGER) AS depth, CAST(len({_SEGS}) - CASE WHEN coalesce(lower({_SEGS}[-1]) IN ('index.html', 'index.php'), false) THEN 1 ELSE 0 END AS INTEGER) AS page_depth"),
    "url15_crawlable": f"{_KEYED} SELECT url, host <> '' AND n <= 3 AND NOT {_FILE} AND regexp_matches(path, '^/[a-z]') AND NOT contains(path, '/prices') AND starts_with(bare, '/news') AS below, host <> '' AND n <= 2 AND NOT {_FILE} AND NOT contains(k, 'utm_') AS anywhere FROM w",
    "url16_discoverable": _sql(f"sch = 'https' AND host = 'quillmere.example' AND prt = '' AND NOT contains(host, 'shop.') AND NOT regexp_matches(path, '\\.html$') AS discoverable, host <> '' AND NOT {_ANY('lower(path)', G.SIGN_IN_PATHS)} AND NOT {_ANY(_LOWQ, G.SIGN_IN_QUERIES)} AND NOT (contains({_LOWQ}, 'hl=') AND NOT contains({_LOWQ}, 'hl=en')) AS worth_visiting"),
    "url17_robots": _sql(f"host <> '' AND CASE WHEN starts_with({_PQ}, '/archive/2025') THEN true WHEN starts_with({_PQ}, '/shop/public') THEN true WHEN starts_with({_PQ}, '/archive') THEN false WHEN regexp_matches({_PQ}, '^/.*\\.html$') THEN false WHEN starts_with({_PQ}, '/shop/') THEN false ELSE true END AS allowed"),
    "url18_blocked": f"WITH i AS (SELECT DISTINCT CAST((scrape_id::HUGEINT * 2654435761) % 4294967296 AS BIGINT) AS n FROM scrapes) SELECT 'http://' || (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) || '/x' AS url, ({_SPECIAL}) AS blocked FROM i",
    "url23_legacy_score": _sql(f"CASE WHEN host = '' THEN -100 ELSE CAST(-10 * len({_SEGS}) - length(qry) + CASE WHEN {_ANY('lower(path)', G.GOOD_WORDS)} THEN 20 ELSE 0 END - CASE WHEN {_ANY('lower(path)', G.BAD_WORDS)} THEN 30 ELSE 0 END AS INTEGER) END AS score"),
    "url24_cache_token": _sql(_component(f"url_encode({_TOKEN})") + " AS token"),
    "url25_blocked": _sql(f"({_ANY('url', G.AD_HOSTS)} OR {_END} IN ('png', 'jpg', 'css')) AS blocked, {_ANY('lower(url)', G.TRACKING_WORDS)} AS tracker"),
}
