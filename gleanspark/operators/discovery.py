"""Discovery of addresses: guesses, site maps, subdomains, their union in order, searches and calls of pages; and the numbers around crawls."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import urls as U
from gleanspark.sources import files

# Paths that sites often have, and where site maps and documents often lie.
COMMON_PATHS = [
    "/api", "/docs", "/documentation", "/help", "/support", "/blog", "/news", "/articles", "/posts", "/guides", "/products", "/services", "/about", "/contact", "/pricing", "/features",
    "/tutorials", "/faq", "/downloads", "/resources", "/tools", "/api/docs", "/swagger", "/openapi", "/graphql", "/rest", "/v1", "/v2", "/api/v1", "/api/v2", "/files", "/documents",
    "/attachments", "/assets", "/media", "/presentations", "/reports", "/whitepapers", "/publications", "/library", "/archive", "/repository", "/static", "/public", "/content", "/data",
]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap.txt", "/sitemaps.xml", "/sitemap1.xml", "/xml_sitemap.xml", "/web_sitemap.xml"]
DOCUMENT_PATHS = [
    "/documents/", "/docs/", "/files/", "/downloads/", "/media/", "/assets/", "/resources/", "/uploads/", "/content/", "/papers/", "/reports/", "/manuals/", "/guides/", "/help/",
    "/documentation/", "/pdf/", "/pdfs/", "/doc/", "/download/", "/file/", "/attachment/", "/attachments/", "/static/", "/public/", "/shared/",
]
DOCUMENT_NAMES, ROOT_NAMES = ["sample", "index", "main", "document", "file"], ["readme", "manual", "guide", "documentation", "spec", "specification"]
DOCUMENT_ENDINGS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".txt", ".rtf", ".odt", ".ods", ".odp", ".csv", ".json", ".xml", ".yaml", ".yml", ".zip", ".rar", ".7z", ".tar", ".gz"]
SUBDOMAINS = ["www", "docs", "blog", "community", "rules", "help", "support", "developer", "learn"]
MAX_LIMIT, MAX_DEPTH, MAX_CRAWLERS, MAX_PATTERNS, MAX_PATTERN = 1000, 10, 10, 25, 200
MAX_APIS, DEFAULT_RESULTS, MAX_MAP = 50, 10, 5000


def _each(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def _product(first: Column, *more: Column) -> Column:
    """All concatenations of arrays of strings, the last varying fastest."""
    def by(m: Column):
        return lambda a: F.transform(m, lambda b: F.concat(a, b))

    out = first
    for m in more:
        out = F.flatten(F.transform(out, by(m)))
    return out


def guesses(origins: DataFrame, origin: str = "origin") -> DataFrame:
    """(origin, url, ord): common paths, then documents by folder, name and ending, then documents at the root.

    The lists are literals, so each origin is exploded where it stands and nothing is joined.
    """
    documents = _product(_each(DOCUMENT_PATHS), F.flatten(F.transform(_each(DOCUMENT_ENDINGS), lambda e: F.transform(_each(DOCUMENT_NAMES), lambda n: F.concat(n, e)))))
    roots = F.flatten(F.transform(_each(DOCUMENT_ENDINGS), lambda e: F.transform(_each(ROOT_NAMES), lambda n: F.concat(F.lit("/"), n, e))))
    return origins.select(origin, F.posexplode(F.concat(_each(COMMON_PATHS), documents, roots)).alias("ord", "path")).select(origin, F.concat(origin, "path").alias("url"), "ord")


def known(candidates: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """The candidates that exist, for which the table of pages answers."""
    return candidates.join(pages.select(url).distinct(), url, "left_semi")


def sitemap_sweep(robots: DataFrame, maps: DataFrame, origin: str, limit: int = MAX_MAP) -> DataFrame:
    """(url): addresses of the maps that robots files and usual paths of an origin name, valid, each once by its key, at most limit."""
    spark = maps.sparkSession
    usual = spark.createDataFrame([(origin + p,) for p in SITEMAP_PATHS], "url string")
    named = files.robots_sitemaps(robots).unionByName(usual).distinct()
    reach = files.sitemap_urls(maps, starts=named)
    return reach.groupBy(U.dedup_key(F.col("url")).alias("k")).agg(F.min("url").alias("url")).orderBy("url").limit(limit).select("url")


def interleaved(rows: DataFrame, host: str, order: str) -> DataFrame:
    """rows with turn: the first of each host, then the second of each, so that no host fills a limit alone."""
    w = Window.partitionBy(host).orderBy(order)
    nth = rows.withColumn("_n", F.row_number().over(w))
    return nth.withColumn("turn", F.row_number().over(Window.partitionBy("_n").orderBy(host))).orderBy("_n", "turn").drop("turn")


def discovered(sources: Sequence[tuple[str, DataFrame]], seed: str, search: str | None = None, exclude: Sequence[str] = (), include: Sequence[str] = (), subdomains: bool = True, limit: int = MAX_MAP) -> tuple[DataFrame, DataFrame]:
    """(links, counts): the union of what several methods found, filtered, each key once, by relevance and then as found; how many each found.

    A source is (method, table of url and ord). Earlier methods go before later ones.
    """
    rows = None
    for k, (method, df) in enumerate(sources):
        part = df.select("url", F.lit(method).alias("method"), F.lit(k).alias("m"), F.col("ord").cast("bigint").alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("method").agg(F.count("*").alias("found"))
    u = F.col("url")
    kept = rows.where(U.is_valid(u) & U.same_site(u, F.lit(seed), subdomains) & U.included(u, include) & ~U.excluded(u, exclude))
    first = kept.groupBy(U.dedup_key(u).alias("key")).agg(F.min(F.struct("m", "ord", "url", "method")).alias("x")).select("key", "x.*")
    links = first.withColumn("score", U.relevance(F.col("url"), search)).orderBy(F.desc("score"), "m", "ord", "url").limit(limit).select("url", "method", "score")
    return links, counts


def kickoff(seed: str, links: DataFrame, spark, first: int = 5, rest: int = 15) -> DataFrame:
    """(url, priority): the seed ahead, what was discovered behind, each key once."""
    all_ = spark.createDataFrame([(seed, first)], "url string, priority int").unionByName(links.select("url", F.lit(rest).alias("priority")))
    return all_.where(U.host(F.col("url")) != "").groupBy(U.crawl_key(F.col("url")).alias("key")).agg(F.min(F.struct("priority", "url")).alias("x")).select("x.url", "x.priority")


def crawl_fronts(seed: str, pages: DataFrame, links: DataFrame, depth: int, limit: int, deep: bool = True) -> DataFrame:
    """(url, depth) by levels, as a browser walks: the limit counts pages visited; unless deep, it ends with the first level that shows nothing new."""
    from gleanspark.operators.crawl import crawl

    spark = pages.sparkSession
    own = links.join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_semi")
    return crawl(own.select("url", "link"), spark.createDataFrame([(seed,)], "url string"), depth=depth if deep else min(depth, 1), budget=limit, best_first=False).select("url", "depth")


def json_calls(log: DataFrame, include_other: bool = False, limit: int = MAX_APIS) -> DataFrame:
    """Calls of pages that look like JSON, or any call of a script if asked: no failures, each method and address once, JSON first, at most limit.

    log has page, url, method, status, content_type, resource_type and ord.
    """
    ct, u = F.lower(F.coalesce("content_type", F.lit(""))), F.col("url")
    is_json = ct.contains("application/json") | ct.contains("+json") | ct.contains("graphql") | u.rlike(r"(?i)/(api|graphql|gql|v\d+)(/|\?|$)") | u.rlike(r"(?i)\.json(\?|$)")
    rows = log.withColumn("is_json", is_json).where("url is not null and status < 400")
    rows = rows.where(F.col("is_json") | (F.col("resource_type").isin("xhr", "fetch") if include_other else F.lit(False)))
    first = rows.groupBy("page", "method", "url").agg(F.min(F.struct("ord", "status", "content_type", "resource_type", "is_json")).alias("x")).select("page", "method", "url", "x.*")
    taken = first.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("ord"))).where(F.col("n") <= limit)
    return taken.withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("is_json"), "ord"))).drop("n", "ord")


def answer_results(answers: DataFrame, limit: int, list_field: str = "results", url_field: str = "url", text_field: str = "content", once: bool = True, key: str = "query", body: str = "body") -> DataFrame:
    """(key, title, url, snippet, position) of search answers as JSON text; results without an address are passed over, others counted again from 1."""
    shape = f"struct<{list_field}: array<struct<title: string, {url_field}: string, {text_field}: string>>>"
    rows = answers.select(key, F.posexplode(F.from_json(body, shape)[list_field]).alias("ord", "r"))
    none = F.lit("")
    rows = rows.select(key, "ord", F.trim(F.coalesce(F.col("r.title"), none)).alias("title"), F.trim(F.col(f"r.{url_field}")).alias("url"), F.trim(F.coalesce(F.col(f"r.{text_field}"), none)).alias("snippet")).where("url is not null and url <> ''")
    if once:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key, "url").orderBy("ord"))).where("_k = 1").drop("_k")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("position") <= limit).drop("ord")


def provider(settings: dict[str, str | None], wanted: str | None = None) -> str:
    """The search provider asked for, else the first that is set up, else the one that needs nothing."""
    have = {k for k, v in settings.items() if v and v.strip()}
    if wanted:
        if wanted != "duckduckgo" and wanted not in have:
            raise ValueError(f"search provider {wanted!r} is selected but not set up")
        return wanted
    return next((p for p in ("serper", "searxng") if p in have), "duckduckgo")


def search_pages(pages: DataFrame, query: str, limit: int | float | None = None, key: str = "scrape_id") -> DataFrame:
    """(key, url, title, position): a search over the pages at hand; terms in the title count three times. Blank queries give none."""
    terms = [t for t in re.split(r"\s+", query.lower().strip()) if t]
    n = result_limit(limit)
    count = lambda c, t: F.size(F.split(F.lower(F.coalesce(c, F.lit(""))), re.escape(t), -1)) - 1
    score = sum((3 * count(F.col("title"), t) + count(F.col("content"), t) for t in terms), F.lit(0))
    found = pages.where("url is not null").select(key, "url", "title", score.alias("score")).where(F.col("score") > 0 if terms else F.lit(False))
    best = found.groupBy("url").agg(F.max(F.struct("score", (-F.col(key)).alias("k"), "title")).alias("x")).select("url", "x.*")
    top = best.orderBy(F.desc("score"), F.desc("k")).limit(n)
    return top.select((-F.col("k")).alias(key), "url", "title", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("k"))).alias("position"))


def result_limit(limit: int | float | None) -> int:
    """A limit of search results: the default for none or what isn't finite, whole and not negative otherwise."""
    return DEFAULT_RESULTS if limit is None or not math.isfinite(limit) else max(0, math.floor(limit))


def granted(want: Column, used: Column, limit: Column) -> Column:
    """How many of the wanted slots of a page budget are left; none for a want of none."""
    return F.greatest(F.lit(0), F.least(want, limit - used))


def clamp(value, low: int, high: int, otherwise: int) -> int:
    """A whole number between bounds; what is no number is the otherwise."""
    try:
        n = float(value)
    except (TypeError, ValueError):
        return otherwise
    return min(max(math.trunc(n), low), high) if math.isfinite(n) else otherwise


def crawl_request(body: dict) -> dict:
    """A valid request to crawl, its numbers within bounds; an error says what is wrong with it."""
    out = dict(body)
    for name in ("url", "webhook"):
        if name == "url" or name in body:
            if not isinstance(body.get(name), str) or not re.match(r"(?i)https?://[^/?#\s]", body[name]):
                raise ValueError(f"{name} must be an http or https address")
    for name in ("includePaths", "excludePaths", "includePatterns", "excludePatterns"):
        patterns = body.get(name)
        if patterns is None:
            continue
        if not isinstance(patterns, list) or not all(isinstance(p, str) for p in patterns):
            raise ValueError(f"{name} must be a list of strings")
        if len(patterns) > MAX_PATTERNS or any(len(p) > MAX_PATTERN for p in patterns):
            raise ValueError(f"{name} may hold {MAX_PATTERNS} patterns of {MAX_PATTERN} characters")
        for p in patterns:
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"{name} holds an invalid expression: {p[:40]}") from e
    for name, low, high in (("limit", 1, MAX_LIMIT), ("maxUrls", 1, MAX_LIMIT), ("maxDepth", 0, MAX_DEPTH), ("maxDiscoveryDepth", 0, MAX_DEPTH)):
        if name in body:
            out[name] = clamp(body[name], low, high, high)
    if isinstance(body.get("crawlOptions"), dict):
        out["crawlOptions"] = body["crawlOptions"] | {k: clamp(body["crawlOptions"][k], 1, MAX_CRAWLERS, 2) for k in ("maxConcurrentCrawlers", "browserPoolSize") if k in body["crawlOptions"]}
    return out


def estimate(limit: Column, browser: Column, extraction: Column, schema: Column) -> tuple[Column, Column, Column]:
    """(pages, mode, calls of a model) of a crawl: a model is asked only for extraction without a schema."""
    pages = F.least(F.coalesce(limit, F.lit(100)), F.lit(MAX_LIMIT))
    return pages, F.when(F.coalesce(browser, F.lit(False)), "browser").otherwise("http"), F.when(F.coalesce(extraction, F.lit(False)) & ~F.coalesce(schema, F.lit(False)), pages).otherwise(0)


def fingerprint_no(seed: Column, profiles: int = 3) -> Column:
    """Which of the browser profiles a seed picks."""
    return F.pmod(seed, F.lit(profiles))


class Deadline:
    """A span of milliseconds from its start; the clock may be given."""

    def __init__(self, total_ms: float, now: Callable[[], float] = lambda: time.monotonic() * 1000):
        self.now, self.end = now, now() + total_ms

    def remaining(self) -> float:
        return max(0.0, self.end - self.now())

    def expired(self) -> bool:
        return self.now() >= self.end


def within(call: Callable[[], object], ms: float, otherwise):
    """The result of a call, or the otherwise if it fails or takes longer; at once where there is no time."""
    from concurrent.futures import ThreadPoolExecutor

    if ms <= 0:
        return otherwise
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(ms / 1000)
    except Exception:
        return otherwise
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def proxy_states(log: DataFrame, proxy: str, order: Sequence[str], ok: str = "ok", at: str = "ts", failures: int = 3, cooldown: str = "1 minute") -> DataFrame:
    """log with failures in a row and cooling_until behind each request: so many failures start a cool-down and are counted again, a success ends both."""
    by = Window.partitionBy(proxy).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy(proxy, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_since", F.sum(F.col(ok).cast("int")).over(by))
    rows = rows.withColumn("_k", F.sum((~F.col(ok)).cast("int")).over(since))
    ends = F.when(~F.col(ok) & (F.col("_k") % failures == 0), F.col(at) + F.expr(f"INTERVAL {cooldown}"))
    return rows.withColumn("failures", (F.col("_k") % failures).cast("int")).withColumn("cooling_until", F.max(ends).over(since)).drop("_since", "_k")


def round_robin(requests: DataFrame, order: Sequence[str], proxies: Sequence[str]) -> DataFrame:
    """requests with the proxy of each in turn; null where there is none."""
    pool = F.array(*map(F.lit, proxies)) if proxies else F.array().cast("array<string>")
    return requests.withColumn("proxy", F.get(pool, (F.row_number().over(Window.orderBy(*order)) - 1) % max(1, len(proxies))))
