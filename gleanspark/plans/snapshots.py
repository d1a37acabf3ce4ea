"""Queries of problem 6, and SQL that says the same."""

from __future__ import annotations

from gleanspark.operators.snapshots import snapshot_changes
from gleanspark.session import table


def p6_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "page_snapshots")).drop("previous_scrape_at")


def p6_line_diffs(spark, sf_dir):
    from pyspark.sql import functions as F

    d = snapshot_changes(table(spark, sf_dir, "page_snapshots"), with_diff=True)
    return d.select("snapshot_no", "url", "options_fingerprint", "change_status", "previous_scrape_at", F.array_join("added", "\n").alias("added"), F.array_join("removed", "\n").alias("removed"))


def txt9_line_delta(spark, sf_dir):
    """Lines added and removed, at most 500 of each."""
    from pyspark.sql import functions as F

    d = snapshot_changes(table(spark, sf_dir, "page_snapshots"), with_diff=True, max_lines=500).where("change_status = 'changed'")
    return d.select("snapshot_no", "url", "options_fingerprint", F.size("added").alias("added"), F.size("removed").alias("removed"))


def txt10_unified(spark, sf_dir):
    """Changed records as unified diffs of their contents."""
    from gleanspark.operators.snapshots import unified_diffs

    return unified_diffs(table(spark, sf_dir, "page_snapshots"))


QUERIES = {"p6_found": p6_found, "p6_line_diffs": p6_line_diffs, "txt9_line_delta": txt9_line_delta, "txt10_unified": txt10_unified}

_BASE = """
WITH latest AS (
  SELECT snapshot_no, url, options_fingerprint, content, scraped_at FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, url, options_fingerprint
      ORDER BY scraped_at DESC NULLS LAST, delivered_at DESC NULLS LAST, sha256(content) DESC NULLS LAST) AS rn FROM page_snapshots
    WHERE snapshot_no IS NOT NULL) WHERE rn = 1),
pairs AS (SELECT * FROM (SELECT snapshot_no AS c, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS p FROM (SELECT DISTINCT snapshot_no FROM latest)) WHERE p IS NOT NULL),
cur AS (SELECT c, url, options_fingerprint, content FROM pairs JOIN latest ON snapshot_no = c),
old AS (SELECT c, url, options_fingerprint, content, scraped_at FROM pairs JOIN latest ON snapshot_no = p),
d AS (SELECT coalesce(a.c, b.c) AS snapshot_no, coalesce(a.url, b.url) AS url, coalesce(a.options_fingerprint, b.options_fingerprint) AS options_fingerprint,
    CASE WHEN b.c IS NULL THEN 'new' WHEN a.c IS NULL THEN 'removed' WHEN a.content IS DISTINCT FROM b.content THEN 'changed' END AS change_status,
    b.scraped_at AS previous_scrape_at, a.content AS cn, b.content AS co
  FROM cur a FULL JOIN old b ON a.c = b.c AND a.url IS NOT DISTINCT FROM b.url AND a.options_fingerprint IS NOT DISTINCT FROM b.options_fingerprint)
"""
_WS = "\\t\\n\\x{B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
_L = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), chr(10)), lambda l: regexp_replace(l, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda l: l <> '')"
_LINES = f""", n AS (SELECT *, {_L("cn")} AS ln, {_L("co")} AS lo FROM d WHERE change_status IS NOT NULL), x AS (SELECT *, list_filter(ln, lambda l: NOT list_contains(lo, l)) AS a0, list_filter(lo, lambda l: NOT list_contains(ln, l)) AS r0 FROM n),
y AS (SELECT *, list_filter(a0, lambda l, i: list_position(a0, l) = i) AS a, list_filter(r0, lambda l, i: list_position(r0, l) = i) AS r FROM x)
"""
SQL = {
    "p6_line_diffs": _BASE + _LINES + "SELECT snapshot_no, url, options_fingerprint, change_status, previous_scrape_at, array_to_string(a, chr(10)) AS added, array_to_string(r, chr(10)) AS removed FROM y",
    "txt9_line_delta": _BASE + _LINES + "SELECT snapshot_no, url, options_fingerprint, CAST(len(a[1:500]) AS INTEGER) AS added, CAST(len(r[1:500]) AS INTEGER) AS removed FROM y WHERE change_status = 'changed'",
    "p6_found": _BASE + "SELECT snapshot_no, url, options_fingerprint, change_status FROM d WHERE change_status IS NOT NULL",
}
