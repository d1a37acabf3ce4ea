"""Queries that crawl and chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.functions import urls as U
from gleanspark.operators.chunker import chunks
from gleanspark.operators.crawl import crawl
from gleanspark.plans.urls import _PARTS, _key
from gleanspark.session import table


def cr3_crawl(spark, d):
    """A crawl over links derived from the pages: page n leads to pages 7n + 3 and 3n + 1 of their number."""
    p = table(spark, d, "pages").where("url is not null").groupBy("page_id").agg(F.min("url").alias("url"))
    n = p.agg(F.max("page_id") + 1).first()[0] or 1
    out = p.select("page_id", "url", F.explode(F.array((F.col("page_id") * 7 + 3) % n, (F.col("page_id") * 3 + 1) % n)).alias("dst"))
    links = out.join(p.select(F.col("page_id").alias("dst"), F.col("url").alias("link")), "dst").select("url", "link")
    return crawl(links, p.where("page_id = 1").select("url"), depth=4, budget=200, words=("shop",)).select("url", "depth")


def txt2_chunks(spark, d):
    return chunks(table(spark, d, "chunk_inputs"))


QUERIES = {"cr3_crawl": cr3_crawl, "txt2_chunks": txt2_chunks}
SQL = {
    "cr3_crawl": _PARTS.replace("SELECT DISTINCT url FROM scrapes WHERE url IS NOT NULL", "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL").replace("WITH u0", "WITH RECURSIVE u0") + f""", k AS (SELECT url, {_key(U.TRACKING_CRAWL, True)} AS key FROM h), p AS (SELECT page_id, min(url) AS url FROM pages WHERE url IS NOT NULL GROUP BY page_id), q AS (SELECT page_id, key FROM p JOIN k USING (url)), m AS (SELECT max(page_id) + 1 AS n FROM p),
e AS (SELECT DISTINCT a.key AS src, b.key AS dst FROM q a, m, q b WHERE b.page_id = (a.page_id * 7 + 3) % n OR b.page_id = (a.page_id * 3 + 1) % n), r AS (SELECT key, 0 AS depth FROM q WHERE page_id = 1 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.key WHERE depth < 4)
SELECT key AS url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY key""",
}
