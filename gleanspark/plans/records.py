"""Queries over scrapes, jobs, snapshots, documents and events, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions import urls as U
from gleanspark.plans.urls import _PARTS, _key
from gleanspark.session import table
from gleanspark.sources.exports import page_record


# Requests a minute that each kind of endpoint allows.
RATE_LIMITS = {"global": 120, "expensive": 20, "crawl": 10, "status": 600}
#: Requests a day, and keys with limits of their own; these are settings of an installation.
DAILY_QUOTA, QUOTA_OVERRIDES = 100, {1: 5, 2: 0}


def _scrapes(spark, d):
    """Each scrape once: its deliveries are the same in every column, so any will do, and columns that nobody asks for aren't read."""
    return table(spark, d, "scrapes").dropDuplicates(["scrape_id"])


def src1_pages(spark, d):
    s = _scrapes(spark, d)
    return s.select("scrape_id", "url", T.js_trim(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "content_type", "status", F.col("error").isNull().alias("success"), "error")


def src3_fallback(spark, d):
    """Per address the first fetch with a body of more than 200 characters, else the latest with any."""
    s = _scrapes(spark, d).where("content is not null").withColumn("good", F.length(T.js_trim(F.col("content"))) > 200)
    w = Window.partitionBy("url").orderBy(F.desc("good"), F.when(F.col("good"), F.col("scraped_at")), F.desc("scraped_at"), "scrape_id")
    return s.where("url is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("url", "scrape_id", "good")


def src14_known(spark, d):
    jobs = table(spark, d, "crawl_jobs").select("url").where("url is not null").distinct()
    return jobs.join(table(spark, d, "scrapes").where("error is null").select("url").distinct(), "url", "left_semi")


def jn1_unvisited(spark, d):
    """Addresses of pages and jobs that no scrape of html visited: by normal form, each once."""
    f = table(spark, d, "crawl_jobs").select("url").unionByName(table(spark, d, "pages").select("url")).where("url is not null").select("url", U.crawl_key(F.col("url")).alias("key")).groupBy("key").agg(F.min("url").alias("url"))
    seen = table(spark, d, "scrapes").where("url is not null and content_type = 'html'").select(U.crawl_key(F.col("url")).alias("key")).distinct()
    return f.join(seen, "key", "left_anti")


def jn4_as_of(spark, d):
    """Each scrape with the latest snapshot of its address before it: both in one order of time per address."""
    s = _scrapes(spark, d).where("url is not null").select("url", F.col("scraped_at").alias("at"), "scrape_id", F.sha2("content", 256).alias("h"), F.lit(0).alias("taken"))
    p = table(spark, d, "page_snapshots").where("url is not null and scraped_at is not null").select("url", F.col("scraped_at").alias("at"), F.lit(None).cast("bigint").alias("scrape_id"), F.sha2("content", 256).alias("h"), F.lit(1).alias("taken")).distinct()
    before = Window.partitionBy("url").orderBy(F.col("at").asc_nulls_first(), "taken", F.col("h").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = s.unionByName(p).withColumn("x", F.last(F.when(F.col("taken") == 1, F.struct("at", "h")), ignorenulls=True).over(before)).where("taken = 0")
    return x.select("scrape_id", F.when(F.col("x").isNull(), "new").when(F.col("h").eqNullSafe(F.col("x.h")), "same").otherwise("changed").alias("change_status"), F.col("x.at").alias("previous_scrape_at"))


def txt1_tokens(spark, d):
    return table(spark, d, "chunk_inputs").select("item_id", "text").distinct().select("item_id", T.word_count(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"))


def txt5_limits(spark, d):
    c = table(spark, d, "chunk_inputs").select("item_id", "max_tokens", "overlap_rate").distinct()
    limit = T.effective_limit(F.col("max_tokens"))
    return c.select("item_id", limit.alias("max_tokens"), T.effective_overlap(F.col("overlap_rate"), limit).alias("overlap"))


def txt4_hard_split(spark, d):
    """Words cut into runs within the limit, in order."""
    c = table(spark, d, "chunk_inputs").where("text is not null").select("item_id", "text", T.effective_limit(F.col("max_tokens")).alias("m")).distinct()
    c = c.select("item_id", F.filter(F.split("text", f"{T.JS_WS}+"), lambda w: w != "").alias("w"), F.greatest(F.lit(1), F.floor(F.col("m") / F.lit(1.3))).cast("int").alias("k")).where(F.size("w") > 0)
    cut = c.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.col("k")), lambda i: F.array_join(F.slice("w", i + 1, F.col("k")), " "))).alias("piece_no", "piece"))
    return cut.select("item_id", (F.col("piece_no") + 1).alias("piece_no"), "piece")


def txt7_grounding_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.normalise_for_grounding(F.col("text")).alias("plain"))


def txt8_keys(spark, d):
    p = table(spark, d, "page_snapshots").select("url", "options_fingerprint").where("url is not null and options_fingerprint is not null").distinct()
    return p.select("url", "options_fingerprint", F.substring(F.sha2(F.concat_ws("::", "url", "options_fingerprint"), 256), 1, 40).alias("key"))


def prj16_contacts(spark, d):
    """Addresses of mail in texts: lower case, first seen, no assets or examples, at most 100."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower)).alias("m"))
    m = F.slice(F.filter("m", lambda e: ~e.rlike(r"\.(png|jpg|jpeg|gif|webp|svg)$") & ~e.contains("example.com")), 1, 100)
    return x.select("doc_id", F.array_join(m, ",").alias("emails"))


def prj20_description(spark, d):
    """First line of more than 30 characters that is no heading and no link, at most 200."""
    lines = F.filter(F.transform(F.split("content", "\n"), T.js_trim), lambda l: (F.length(l) > 30) & ~l.startswith("#") & ~l.startswith("["))
    return _scrapes(spark, d).where("content is not null").select("scrape_id", F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 200).alias("description"))


def ext3_numbers(spark, d):
    n = F.regexp_extract(F.replace("content", F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return _scrapes(spark, d).where("content is not null").select("scrape_id", n.try_cast("double").alias("number"))


def ext4_signature(spark, d):
    """Host and path with numbers and long hexadecimal names as :id."""
    p = F.regexp_replace(F.regexp_replace(U.path(F.col("url")), r"/[0-9]+(?=/|$)", "/:id"), r"(?i)/[0-9a-f]{8,}(?=/|$)", "/:id")
    return table(spark, d, "scrapes").where("url is not null").select("url", F.when(U.host(F.col("url")) == "", F.col("url")).otherwise(F.concat(U.host(F.col("url")), p)).alias("signature")).distinct()


def ext7_yield(spark, d):
    """Per site: share of records with each field; healthy if the least is half or more."""
    s = _scrapes(spark, d).withColumn("site", T.site_of(F.col("url"))).where("site is not null")
    full = lambda c: F.avg(F.coalesce(T.js_trim(F.col(c)) != "", F.lit(False)).cast("double"))
    g = s.groupBy("site").agg(F.count("*").alias("records"), full("title").alias("title_ratio"), full("content").alias("content_ratio"))
    return g.select("site", "records", F.least("title_ratio", "content_ratio").alias("ratio"), (F.least("title_ratio", "content_ratio") >= 0.5).alias("healthy"))


def ext15_grounded(spark, d):
    """Whether the title of a scrape is grounded in its content: within it, or three in five of its longer words are; too short to tell counts as grounded."""
    s = _scrapes(spark, d).where("title is not null and content is not null").select("scrape_id", "title", T.normalise_for_grounding(F.col("title")).alias("t"), T.normalise_for_grounding(F.col("content")).alias("c"))
    words = F.filter(F.split("t", " "), lambda w: F.length(w) > 2)
    hit = F.size(F.filter(words, lambda w: F.col("c").contains(w)))
    return s.select("scrape_id", F.when(F.col("title") == "", False).otherwise((F.length("t") < 2) | F.col("c").contains(F.col("t")) | (F.size(words) == 0) | (hit >= F.size(words) * F.lit(0.6))).alias("grounded"))


def ext18_placeholders(spark, d):
    t = _scrapes(spark, d).where("content is not null")
    return t.select("scrape_id", F.array_join(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\{(\w+)\}"), F.lit(1))), ",").alias("names"))


def _jobs(spark, d):
    return table(spark, d, "crawl_jobs").distinct().withColumn("status", F.lower(F.trim("status")))


def _outcomes(spark, d):
    """One row per job: success overrides failure, else the last attempt holds."""
    return _jobs(spark, d).groupBy("crawl_id", "job_id").agg(F.bool_or(F.col("status") == "completed").alias("ok"), F.max(F.struct("attempt", "received_at", "status", "error")).alias("x")).select("crawl_id", "job_id", F.when(F.col("ok"), "completed").otherwise(F.col("x.status")).alias("status"), F.when(~F.col("ok"), F.nullif(F.col("x.error"), F.lit(""))).alias("error"), F.col("x.attempt").alias("attempts"))


def ag1_progress(spark, d):
    o = _outcomes(spark, d)
    done = F.col("status").isin("completed", "failed")
    g = o.groupBy("crawl_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done).alias("done"))
    return g.withColumn("finished", F.col("done") == F.col("total"))


def ag4_rollup(spark, d):
    g = ag1_progress(spark, d)
    status = F.when(F.col("done") < F.col("total"), "processing").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    return g.select("crawl_id", status.alias("status"), F.floor(F.lit(100.0) * F.col("done") / F.col("total") + 0.5).cast("int").alias("progress"))


def ag5_errors(spark, d):
    return _outcomes(spark, d).where("status = 'failed'").select("crawl_id", "job_id", F.coalesce("error", F.lit("")).alias("error"))


def ag7_histogram(spark, d):
    """Cumulative buckets of seconds between an attempt and its arrival."""
    j = _jobs(spark, d).withColumn("s", (F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6)
    return j.groupBy("status").agg(*[F.count_if(F.col("s") <= b).alias(f"le_{n}") for b, n in ((0.5, "05"), (1.0, "1"), (5.0, "5"), (3600.0, "3600"))], F.count("*").alias("n"))


def ag12_throughput(spark, d):
    return _jobs(spark, d).where("status = 'completed'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("jobs"), (F.count("*") / 60.0).alias("per_minute"))


def cr10_estimate(spark, d):
    return _outcomes(spark, d).groupBy("crawl_id").agg(F.ceil(F.count("*") / F.lit(5.0) * 30000.0).cast("long").alias("millis"))


def cr18_rate(spark, d):
    """Requests per key and minute against the limits of each kind of endpoint."""
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return e.select("user_id", "minute", "n", *[(F.col("n") > limit).alias(f"over_{name}") for name, limit in RATE_LIMITS.items()])


def cr19_quota(spark, d):
    """Usage per key and day: some keys have limits of their own, a limit of zero is none."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    limit = F.lit(DAILY_QUOTA)
    for key, own in QUOTA_OVERRIDES.items():
        limit = F.when(F.col("user_id") == key, own).otherwise(limit)
    e = e.withColumn("daily_limit", F.when(limit > 0, limit))
    return e.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "used", "daily_limit", F.greatest(F.lit(0), F.col("daily_limit") - F.col("used")).alias("remaining"), (F.col("used") > F.col("daily_limit")).alias("exceeded"))


def cr25_retry(spark, d):
    """Whether a failed attempt is tried again for its text, and the wait without jitter."""
    j = _jobs(spark, d).where("status = 'failed'")
    return j.select("job_id", "attempt", "received_at", F.coalesce(F.lower("error").rlike("429|too many requests|rate limit"), F.lit(False)).alias("limited"), F.least(F.lit(10000.0), F.lit(1000.0) * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("wait_ms"))


def tk4_page(spark, d):
    return _scrapes(spark, d).select("scrape_id", "url").orderBy("scrape_id").offset(20).limit(20)


def tk5_recent(spark, d):
    return table(spark, d, "crawl_jobs").groupBy("crawl_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "crawl_id").limit(100)


def snk1_filenames(spark, d):
    """Names of exported files: date, crawl, host, path and query, with other characters as one underscore."""
    u = F.col("url")
    path = F.substring(F.regexp_replace(F.regexp_replace(U.path(u), "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", ""), 1, 100)
    query = F.substring(F.regexp_replace(F.regexp_replace(U.query(u), "[^A-Za-z0-9.&=-]+", "_"), "_+$", ""), 1, 50)
    parts = F.array(F.date_format("scraped_at", "yyyy-MM-dd"), F.substring("crawl_id", 1, 8), U.domain(u), F.nullif(path, F.lit("")), F.nullif(query, F.lit("")))
    return _scrapes(spark, d).where("url is not null and crawl_id is not null and content_type = 'markdown'").select("scrape_id", F.concat(F.substring(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "_"), 1, 150), F.lit(".md")).alias("file"))


def prj18_records(spark, d):
    """The public view of each scrape."""
    r = page_record(F.col("url"), F.col("title"), F.col("content"), F.struct("status", "scraped_at"))
    return _scrapes(spark, d).select("scrape_id", r.alias("r")).select("scrape_id", "r.url", "r.title", "r.markdown", "r.metadata.status", "r.metadata.scraped_at")


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0][:2] in ("sr", "jn", "tx", "pr", "ex", "ag", "cr", "tk", "sn") and callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_S = "WITH s AS (SELECT DISTINCT scrape_id, crawl_id, url, title, content, content_type, status, scraped_at, error FROM scrapes)\n"
_TRIM = "regexp_replace({}, '^[\\t\\n\\x{{B}}\\f\\r \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+|[\\t\\n\\x{{B}}\\f\\r \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')"
_WS = "[\\t\\n\\x{B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
_WORDS = f"list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')"
_SITE = r"nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', ''), '')"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) END"
_SIG = f"CASE WHEN {_HOST} = '' THEN url ELSE {_HOST} || array_to_string(list_transform(string_split({_PATH}, '/'), lambda x: CASE WHEN regexp_matches(x, '^([0-9]+|[0-9a-fA-F]{{8,}})$') THEN ':id' ELSE x END), '/') END"
_O = """WITH j AS (SELECT DISTINCT * REPLACE (lower(trim(status)) AS status) FROM crawl_jobs),
o AS (SELECT crawl_id, job_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' ELSE arg_max(status, {'a': attempt, 'r': received_at, 's': status}) END AS status,
 CASE WHEN NOT bool_or(status = 'completed') THEN arg_max(coalesce(error, ''), {'a': attempt, 'r': received_at, 's': status, 'e': error}) END AS error, max(attempt) AS attempts FROM j GROUP BY ALL),
g AS (SELECT crawl_id, count(*) AS total, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('completed', 'failed')) AS done FROM o GROUP BY ALL)
"""


_UNVISITED = _PARTS.replace("SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL", "SELECT url FROM crawl_jobs WHERE url IS NOT NULL UNION SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT url FROM scrapes WHERE url IS NOT NULL AND content_type = 'html'") + f""", k AS (SELECT url, {_key(U.TRACKING_CRAWL, True)} AS key FROM h)
SELECT key, min(url) AS url FROM k WHERE url IN (SELECT url FROM crawl_jobs UNION SELECT url FROM pages) AND key NOT IN (SELECT key FROM k WHERE url IN (SELECT url FROM scrapes WHERE url IS NOT NULL AND content_type = 'html')) GROUP BY key"""


def _plain(c):
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9{_WS[1:-2]}]', ' ', 'g'), '{_WS}', ' ', 'g'))"


SQL = {
    "src1_pages": _S + f"SELECT scrape_id, url, {_TRIM.format('coalesce(title, chr(32))')} AS title, coalesce(content, '') AS content, content_type, status, error IS NULL AS success, error FROM s",
    "src14_known": "SELECT DISTINCT url FROM crawl_jobs WHERE url IN (SELECT url FROM scrapes WHERE error IS NULL AND url IS NOT NULL)",
    "jn4_as_of": "WITH s AS (SELECT DISTINCT scrape_id, url, scraped_at, sha256(content) AS h FROM scrapes WHERE url IS NOT NULL), p AS (SELECT DISTINCT url, scraped_at AS seen_at, sha256(content) AS ph FROM page_snapshots), b AS (SELECT scrape_id, arg_max(ph, seen_at) AS ph, max(seen_at) AS seen_at FROM (SELECT scrape_id, seen_at, coalesce(ph, '-') AS ph FROM s JOIN p USING (url) WHERE seen_at < scraped_at) GROUP BY ALL) SELECT scrape_id, CASE WHEN seen_at IS NULL THEN 'new' WHEN coalesce(h, '-') = ph THEN 'same' ELSE 'changed' END AS change_status, seen_at AS previous_scrape_at FROM s LEFT JOIN b USING (scrape_id)",
    "txt1_tokens": f"SELECT item_id, CAST(coalesce(len({_WORDS}), 0) AS INTEGER) AS words, CAST(ceil(coalesce(len({_WORDS}), 0) * 1.3::DOUBLE) AS INTEGER) AS tokens FROM (SELECT DISTINCT item_id, text FROM chunk_inputs)",
    "txt5_limits": "SELECT item_id, m AS max_tokens, CAST(least(floor(m * CASE WHEN overlap_rate IS NOT NULL AND NOT isnan(overlap_rate) AND overlap_rate >= 0 AND NOT isinf(overlap_rate) THEN overlap_rate ELSE 0.1::DOUBLE END), m - 1) AS INTEGER) AS overlap FROM (SELECT DISTINCT item_id, CASE WHEN max_tokens > 0 THEN max_tokens ELSE 2048 END AS m, overlap_rate FROM chunk_inputs)",
    "txt4_hard_split": f"WITH c AS (SELECT item_id, {_WORDS} AS w, CAST(greatest(1, floor(m / 1.3::DOUBLE)) AS BIGINT) AS k FROM (SELECT DISTINCT item_id, text, CASE WHEN max_tokens > 0 THEN max_tokens ELSE 2048 END AS m FROM chunk_inputs WHERE text IS NOT NULL)), i AS (SELECT item_id, w, k, unnest(range(0, len(w), k)) AS i FROM c WHERE len(w) > 0) SELECT item_id, CAST(i // k + 1 AS INTEGER) AS piece_no, array_to_string(w[i + 1 : i + k], ' ') AS piece FROM i",
    "txt7_grounding_text": f"SELECT doc_id, {_plain('text')} AS plain FROM documents WHERE text IS NOT NULL",
    "txt8_keys": "SELECT DISTINCT url, options_fingerprint, left(sha256(url || '::' || options_fingerprint), 40) AS key FROM page_snapshots WHERE url IS NOT NULL AND options_fingerprint IS NOT NULL",
    "ext3_numbers": _S + r"SELECT scrape_id, try_cast(nullif(regexp_extract(replace(content, ',', ''), '-?[0-9]+(?:\.[0-9]+)?', 0), '') AS DOUBLE) AS number FROM s WHERE content IS NOT NULL",
    "ext4_signature": f"SELECT DISTINCT url, {_SIG} AS signature FROM scrapes WHERE url IS NOT NULL",
    "ext7_yield": _S + f", r AS (SELECT {_SITE} AS site, count(*) AS records, avg(CASE WHEN {_TRIM.format('title')} <> '' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN {_TRIM.format('content')} <> '' THEN 1.0 ELSE 0 END) AS b FROM s GROUP BY 1) SELECT site, records, least(a, b) AS ratio, least(a, b) >= 0.5 AS healthy FROM r WHERE site IS NOT NULL",
    "ext15_grounded": _S + f", n AS (SELECT scrape_id, title, {_plain('title')} AS t, {_plain('content')} AS c FROM s WHERE title IS NOT NULL AND content IS NOT NULL), w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: length(x) > 2) AS w FROM n) SELECT scrape_id, CASE WHEN title = '' THEN false ELSE length(t) < 2 OR contains(c, t) OR len(w) = 0 OR len(list_filter(w, lambda x: contains(c, x))) >= len(w) * 0.6::DOUBLE END AS grounded FROM w",
    "ag1_progress": _O + "SELECT *, done = total AS finished FROM g",
    "ag4_rollup": _O + "SELECT crawl_id, CASE WHEN done < total THEN 'processing' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, CAST(floor(100.0::DOUBLE * done / total + 0.5) AS INTEGER) AS progress FROM g",
    "ag5_errors": _O + "SELECT crawl_id, job_id, error FROM o WHERE status = 'failed'",
    "ag7_histogram": _O + ", x AS (SELECT status, (epoch_us(received_at) - epoch_us(ts)) / 1e6 AS s FROM j) SELECT status, count(*) FILTER (s <= 0.5) AS le_05, count(*) FILTER (s <= 1) AS le_1, count(*) FILTER (s <= 5) AS le_5, count(*) FILTER (s <= 3600) AS le_3600, count(*) AS n FROM x GROUP BY ALL",
    "ag12_throughput": _O + "SELECT date_trunc('hour', ts) AS hour, count(*) AS jobs, count(*) / 60.0 AS per_minute FROM j WHERE status = 'completed' GROUP BY ALL",
    "cr10_estimate": _O + "SELECT crawl_id, CAST(ceil(count(*) / 5.0::DOUBLE * 30000) AS BIGINT) AS millis FROM o GROUP BY ALL",
    "cr18_rate": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, " + ", ".join(f"count(*) > {v} AS over_{k}" for k, v in RATE_LIMITS.items()) + " FROM events GROUP BY ALL",
    "cr19_quota": "WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, CASE user_id WHEN 1 THEN 5 WHEN 2 THEN NULL ELSE 100 END AS daily_limit FROM events GROUP BY 1, 2) SELECT user_id, day, used, daily_limit, greatest(0, daily_limit - used) AS remaining, used > daily_limit AS exceeded FROM e",
    "cr25_retry": _O + "SELECT job_id, attempt, received_at, coalesce(regexp_matches(lower(error), '429|too many requests|rate limit'), false) AS limited, least(10000.0::DOUBLE, 1000.0::DOUBLE * power(2.0::DOUBLE, attempt - 1)) AS wait_ms FROM j WHERE status = 'failed'",
    "tk4_page": _S + "SELECT scrape_id, url FROM s ORDER BY scrape_id LIMIT 20 OFFSET 20",
    "tk5_recent": "SELECT crawl_id, max(ts) AS last FROM crawl_jobs GROUP BY ALL ORDER BY last DESC, crawl_id LIMIT 100",
    "prj18_records": _S + "SELECT scrape_id, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(content, '') AS markdown, status, scraped_at FROM s",
    "src3_fallback": _S + f", g AS (SELECT *, length({_TRIM.format('content')}) > 200 AS good FROM s WHERE content IS NOT NULL AND url IS NOT NULL) SELECT url, scrape_id, good FROM g QUALIFY row_number() OVER (PARTITION BY url ORDER BY good DESC, CASE WHEN good THEN scraped_at END NULLS FIRST, scraped_at DESC NULLS LAST, scrape_id) = 1",
    "prj16_contacts": r"SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda e: NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|webp|svg)$') AND NOT contains(e, 'example.com'))[1:100], ',') AS emails FROM (SELECT doc_id, list_transform(list_filter(m, lambda x, i: list_position(m, x) = i), lambda x: x) AS list_distinct_ordered FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)) AS m FROM documents WHERE text IS NOT NULL))",
    "prj20_description": _S + f"SELECT scrape_id, left(coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: length(l) > 30 AND NOT starts_with(l, '#') AND NOT starts_with(l, '['))[1], ''), 200) AS description FROM s WHERE content IS NOT NULL",
    "ext18_placeholders": _S + r"SELECT scrape_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS names FROM (SELECT scrape_id, regexp_extract_all(content, '\{(\w+)\}', 1) AS m FROM s WHERE content IS NOT NULL)",
    "snk1_filenames": _S + rf"SELECT scrape_id, left(array_to_string(list_filter([strftime(scraped_at, '%Y-%m-%d'), left(crawl_id, 8), regexp_replace({_HOST}, '^www\.', ''), nullif(left(regexp_replace(regexp_replace({_PATH}, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g'), 100), ''), nullif(left(regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '[^A-Za-z0-9.&=-]+', '_', 'g'), '_+$', '', 'g'), 50), '')], lambda x: x IS NOT NULL), '_'), 150) || '.md' AS file FROM s WHERE url IS NOT NULL AND crawl_id IS NOT NULL AND content_type = 'markdown'",
    "jn1_unvisited": _UNVISITED,
}
