"""Queries that run streams over the tables, in files of the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanspark.functions.urls import TRACKING_CRAWL
from gleanspark.plans.discovery import _PROXY
from gleanspark.plans.urls import _PARTS, _key
from gleanspark.session import shared_folder
from gleanspark.streaming import state as S

BUCKETS = {"le_1": 1.0, "le_60": 60.0, "le_3600": 3600.0}


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drained(spark, stream):
    at = _folder(spark)
    return S.drain(stream, f"{at}/state", f"{at}/rows")


def _updated(spark, stream, keys):
    at = _folder(spark)
    return S.drain_updates(stream, keys, f"{at}/state", f"{at}/rows")


def st1_first_visits(spark, d):
    return _drained(spark, S.first_visits(S.table_stream(spark, d, "crawl_jobs")).select("crawl_id", "url_key"))


def st2_daily_quota(spark, d):
    """Days that the watermark has closed."""
    return _drained(spark, S.windowed_counts(S.table_stream(spark, d, "events"), ["user_id"], "1 day"))


def st3_rates(spark, d):
    """Requests a minute, of minutes that the watermark has closed."""
    return _drained(spark, S.windowed_counts(S.table_stream(spark, d, "events"), ["user_id"], "1 minute"))


def st4_sessions(spark, d):
    return _drained(spark, S.idle_sessions(S.table_stream(spark, d, "events"), "user_id"))


def st5_proxies(spark, d):
    j = S.timed(S.table_stream(spark, d, "crawl_jobs")).where("ts is not null and status is not null").withColumn("status", F.lower(F.trim("status")))
    j = j.select(F.pmod(F.ascii(F.substring("job_id", -1, 1)), F.lit(5)).alias("proxy"), "ts", "job_id", "attempt", "status", (F.col("status") == "completed").alias("ok"))
    return _drained(spark, S.proxies(j.withWatermark("ts", "1 day").dropDuplicates(["proxy", "ts", "job_id", "attempt", "status"])))


def st6_changes(spark, d):
    return _drained(spark, S.changes(S.table_stream(spark, d, "page_snapshots")))


def st7_pages(spark, d):
    """Each page of a crawl once, as it arrives."""
    s = S.timed(S.table_stream(spark, d, "scrapes"), "scraped_at").where("crawl_id is not null").withWatermark("scraped_at", "24 hours")
    return _drained(spark, s.dropDuplicatesWithinWatermark(["crawl_id", "scrape_id"]).select("crawl_id", "scrape_id", "url"))


def st7_progress(spark, d):
    return _updated(spark, S.progress(S.table_stream(spark, d, "crawl_jobs")), ["crawl_id"])


def st8_throughput(spark, d):
    """Completed jobs an hour, of hours that the watermark has closed."""
    done = S.table_stream(spark, d, "crawl_jobs").where("lower(trim(status)) = 'completed'")
    return _drained(spark, S.windowed_counts(done, [], "1 hour"))


def st9_histogram(spark, d):
    return _updated(spark, S.delays(S.table_stream(spark, d, "crawl_jobs"), BUCKETS), ["status"])


QUERIES = {f.__name__: f for f in (st1_first_visits, st2_daily_quota, st3_rates, st4_sessions, st5_proxies, st6_changes, st7_pages, st7_progress, st8_throughput, st9_histogram)}


def _closed(source, keys, unit, interval, where="true"):
    k = "".join(f"{x}, " for x in keys)
    return f"WITH e AS (SELECT * FROM {source} WHERE {where}), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM e) SELECT {k}CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS start, count(*) AS n FROM e, m GROUP BY {k}date_trunc('{unit}', ts), w HAVING date_trunc('{unit}', ts) + INTERVAL {interval} <= w"


SQL = {
    "st1_first_visits": _PARTS.replace("SELECT DISTINCT url FROM scrapes", "SELECT DISTINCT url FROM crawl_jobs") + f", k AS (SELECT url, {_key(TRACKING_CRAWL, True)} AS url_key FROM h) SELECT DISTINCT crawl_id, url_key FROM crawl_jobs JOIN k USING (url)",
    "st2_daily_quota": _closed("events", ["user_id"], "day", "1 DAY"),
    "st3_rates": _closed("events", ["user_id"], "minute", "1 MINUTE"),
    "st4_sessions": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s, m GROUP BY user_id, no, w HAVING max(ts) + INTERVAL 30 MINUTE <= w""",
    "st5_proxies": _PROXY + "SELECT CAST(proxy AS INTEGER) AS proxy, job_id, attempt, status, failures, cooling_until FROM p",
    "st6_changes": """WITH d AS (SELECT DISTINCT url, options_fingerprint, scraped_at, coalesce(sha256(content), '') AS h FROM page_snapshots WHERE scraped_at IS NOT NULL),
l AS (SELECT *, lag(h) OVER w AS ph, lag(scraped_at) OVER w AS pt FROM d WINDOW w AS (PARTITION BY url, options_fingerprint ORDER BY scraped_at, h)) SELECT url, options_fingerprint, scraped_at, CASE WHEN pt IS NULL OR epoch_ms(scraped_at) - epoch_ms(pt) > 2592000000 THEN 'new' WHEN h = ph THEN 'same' ELSE 'changed' END AS change_status FROM l""",
    "st7_pages": "SELECT DISTINCT crawl_id, scrape_id, url FROM scrapes WHERE crawl_id IS NOT NULL",
    "st7_progress": "SELECT crawl_id, count(*) AS attempts, count(*) FILTER (lower(trim(status)) = 'completed') AS completed, count(*) FILTER (lower(trim(status)) = 'failed') AS failed FROM crawl_jobs GROUP BY crawl_id",
    "st8_throughput": _closed("crawl_jobs", [], "hour", "1 HOUR", "lower(trim(status)) = 'completed'"),
    "st9_histogram": "WITH x AS (SELECT lower(trim(status)) AS status, (epoch_us(received_at) - epoch_us(ts)) / 1e6 AS s FROM crawl_jobs) SELECT status, " + ", ".join(f"count(*) FILTER (s <= {b}) AS {n}" for n, b in BUCKETS.items()) + ", count(*) AS n FROM x GROUP BY status",
}
