"""Queries of exports, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.plans.records import _O, _S, _scrapes, ag1_progress
from gleanspark.sources import exports as X
from gleanspark.sources import files
from gleanspark.session import table


def _pages(spark, d):
    return _scrapes(spark, d).where("crawl_id is not null")


def snk2_summaries(spark, d):
    return X.summary(_pages(spark, d).where("scraped_at is not null"))


def snk3_consolidated(spark, d):
    return X.consolidated(_pages(spark, d).select("crawl_id", "scrape_id", "title", "content"))


def snk4_manifest(spark, d):
    p = X.numbered(_pages(spark, d).where("url is not null").select("crawl_id", "scrape_id", "url"), "crawl_id", "scrape_id")
    return p.select("crawl_id", "scrape_id", X.archive_name(F.col("url"), F.col("index")).alias("file"))


def snk4_archives(spark, d):
    return X.archives(_pages(spark, d).select("crawl_id", "scrape_id", "url", "title", "content")).select("crawl_id", "archive_no", "pages", F.length("data").alias("bytes"))


def snk5_json(spark, d):
    """Each page as a record of JSON, in order within its crawl."""
    p = X.numbered(_pages(spark, d).where("content is not null").select("crawl_id", "scrape_id", "url", "title", "content", "status"), "crawl_id", "scrape_id")
    record = X.page_record(F.col("url"), F.col("title"), F.col("content"), F.struct(F.coalesce("status", F.lit(0)).alias("status")))
    return p.select("crawl_id", "index", F.to_json(record).alias("record"))


def snk6_batches(spark, d):
    """The summary of each batch as JSON."""
    g = ag1_progress(spark, d)
    return g.select("crawl_id", F.to_json(F.struct(F.col("crawl_id").alias("batchId"), F.col("total").alias("totalUrls"), F.col("succeeded").alias("completedUrls"), F.col("failed").alias("failedUrls"))).alias("summary"))


def snk8_notices(spark, d):
    """What a webhook is told when a crawl is done."""
    g = ag1_progress(spark, d).where("finished").select("crawl_id", "total", "failed")
    return X.notices(g, "batch_scrape.completed")


def snk9_cache(spark, d):
    """Snapshots that a cache of sixty days still holds at the last delivery."""
    p = table(spark, d, "page_snapshots").where("url is not null and delivered_at is not null").select("url", "options_fingerprint", "snapshot_no", "delivered_at").distinct()
    now = p.agg(F.max("delivered_at")).first()[0]
    held = p.withColumn("expires_at", F.col("delivered_at") + F.expr("INTERVAL 60 DAYS"))
    return files.alive(held, now).groupBy("url", "options_fingerprint").agg(F.max("snapshot_no").alias("snapshot_no"))


def snk10_expired(spark, d):
    """Scrapes more than a week older than the newest."""
    s = _scrapes(spark, d).select("scrape_id", "scraped_at")
    newest = s.agg(F.max("scraped_at").alias("now"))
    return X.expired(s.join(F.broadcast(newest)), F.col("now"), 7, "scraped_at").select("scrape_id")


def snk11_metrics(spark, d):
    """Counters, gauges and histograms of the jobs as lines of text."""
    j = table(spark, d, "crawl_jobs").distinct().withColumn("status", F.lower(F.trim("status"))).where("status is not null")
    labels = F.create_map(F.lit("status"), F.col("status"))
    counts = j.groupBy("status").agg(F.count("*").alias("value")).select(F.lit("jobs_total").alias("name"), labels.alias("labels"), "value")
    waits = j.where("received_at is not null and ts is not null").select(F.lit("job_delay_seconds").alias("name"), labels.alias("labels"), F.floor((F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6).alias("value"))
    crawls = j.groupBy().agg(F.countDistinct("crawl_id").alias("value")).select(F.lit("crawls").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    return files.metrics(counters=counts, gauges=crawls, observed=waits, buckets=(1, 60, 3600, 86400))


def txt11_front_matter(spark, d):
    """Pages written as files and read again: title, address and the text behind."""
    s = _pages(spark, d).select("scrape_id", X.front_matter(F.col("url"), F.col("title"), F.date_format("scraped_at", "yyyy-MM-dd"), F.col("content")).alias("file"))
    meta, title, rest = X.parsed_matter(F.col("file"))
    return s.select("scrape_id", meta["url"].alias("url"), title.alias("title"), F.sha2(rest, 256).alias("rest"))


QUERIES = {f.__name__: f for f in (snk2_summaries, snk3_consolidated, snk4_manifest, snk4_archives, snk5_json, snk6_batches, snk8_notices, snk9_cache, snk10_expired, snk11_metrics, txt11_front_matter)}

_PAGES = _S + ", p AS (SELECT * FROM s WHERE crawl_id IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY scrape_id) - 1 AS index FROM p)\n"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_PATHQ = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)', 1) END || CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) END"
_NAMES = f"regexp_replace(regexp_replace({_PATHQ}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_LE = " UNION ALL ".join(f"SELECT status, '{b}' AS le, count(*) FILTER (v <= {b}) AS n FROM w GROUP BY status" for b in (1, 60, 3600, 86400))
SQL = {
    "snk2_summaries": _S + """, g AS (SELECT crawl_id, arg_min(coalesce(url, ''), {'a': scraped_at, 'u': coalesce(url, '')}) AS first, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n, count(*) FILTER (error IS NULL) AS ok FROM s WHERE crawl_id IS NOT NULL AND scraped_at IS NOT NULL GROUP BY ALL)
SELECT crawl_id, array_to_string(['# Crawl Summary', '', '**Crawl ID:** ' || crawl_id, '**Initial URL:** ' || first, '**Start Time:** ' || began, '**End Time:** ' || ended, '**Total Pages:** ' || n, '**Successful:** ' || ok, '**Failed:** ' || (n - ok)], chr(10)) AS text FROM g""",
    "snk3_consolidated": _PAGES + """SELECT crawl_id, 0 AS part_no, '# Consolidated Crawl Results' || chr(10) || chr(10) || '**Crawl ID:** ' || crawl_id || chr(10) || '**Total Files:** ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS part FROM p GROUP BY crawl_id
UNION ALL SELECT crawl_id, index + 1, '## ' || coalesce(nullif(title, ''), 'page ' || scrape_id) || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM x""",
    "snk4_manifest": _PAGES.replace("crawl_id IS NOT NULL", "crawl_id IS NOT NULL AND url IS NOT NULL") + f"SELECT crawl_id, scrape_id, CASE WHEN {_HOST} = '' THEN CASE WHEN index < 10000 THEN lpad(index::VARCHAR, 4, '0') ELSE index::VARCHAR END || '_page.md' ELSE left(CASE WHEN index < 10000 THEN lpad(index::VARCHAR, 4, '0') ELSE index::VARCHAR END || '_' || regexp_replace({_HOST}, '[^a-zA-Z0-9]+', '_', 'g') || '_' || CASE WHEN {_NAMES} = '' THEN 'index' ELSE {_NAMES} END || '.md', 180) END AS file FROM x",
    "snk5_json": _PAGES.replace("crawl_id IS NOT NULL", "crawl_id IS NOT NULL AND content IS NOT NULL") + "SELECT crawl_id, index, CAST(to_json({'url': coalesce(url, ''), 'title': coalesce(title, ''), 'markdown': content, 'metadata': {'status': coalesce(status, 0)}}) AS VARCHAR) AS record FROM x",
    "snk6_batches": _O + "SELECT crawl_id, CAST(to_json({'batchId': crawl_id, 'totalUrls': total, 'completedUrls': succeeded, 'failedUrls': failed}) AS VARCHAR) AS summary FROM g",
    "snk8_notices": _O + "SELECT CAST(to_json({'event': 'batch_scrape.completed', 'data': {'crawl_id': crawl_id, 'total': total, 'failed': failed}}) AS VARCHAR) AS payload FROM g WHERE done = total",
    "snk9_cache": "WITH p AS (SELECT * FROM page_snapshots WHERE url IS NOT NULL AND delivered_at IS NOT NULL) SELECT url, options_fingerprint, max(snapshot_no) AS snapshot_no FROM p WHERE delivered_at + INTERVAL 60 DAY > (SELECT max(delivered_at) FROM p) GROUP BY ALL",
    "snk10_expired": "SELECT DISTINCT scrape_id FROM scrapes WHERE scraped_at < (SELECT max(scraped_at) FROM scrapes) - INTERVAL 7 DAY",
    "snk11_metrics": f"""WITH j AS (SELECT DISTINCT * REPLACE (lower(trim(status)) AS status) FROM crawl_jobs WHERE status IS NOT NULL), w AS (SELECT status, CAST(floor((epoch_us(received_at) - epoch_us(ts)) / 1e6) AS BIGINT) AS v FROM j WHERE received_at IS NOT NULL AND ts IS NOT NULL), b AS ({_LE})
SELECT unnest(['# TYPE jobs_total counter', '# TYPE crawls gauge', '# TYPE job_delay_seconds histogram']) AS line UNION ALL SELECT 'jobs_total{{status="' || status || '"}} ' || count(*) FROM j GROUP BY status UNION ALL SELECT 'crawls ' || count(DISTINCT crawl_id) FROM j
UNION ALL SELECT 'job_delay_seconds_bucket{{status="' || status || '",le="' || le || '"}} ' || n FROM b UNION ALL SELECT 'job_delay_seconds_bucket{{status="' || status || '",le="+Inf"}} ' || count(*) FROM w GROUP BY status
UNION ALL SELECT 'job_delay_seconds_sum{{status="' || status || '"}} ' || sum(v) FROM w GROUP BY status UNION ALL SELECT 'job_delay_seconds_count{{status="' || status || '"}} ' || count(*) FROM w GROUP BY status""",
    "txt11_front_matter": _PAGES + "SELECT scrape_id, coalesce(url, '') AS url, nullif(trim(title), '') AS title, sha256(chr(10) || coalesce(content, '')) AS rest FROM p",
}
