"""Queries around structured extraction, and SQL that says the same."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions import urls as U
from gleanspark.operators import extraction as X
from gleanspark.operators import pages as P
from gleanspark.operators.store import latest
from gleanspark.plans.guards import _component
from gleanspark.plans.pages import ARTICLE
from gleanspark.plans.records import _S, _SIG, _SITE, _plain, _scrapes, ext4_signature
from gleanspark.session import table

SCHEMA = {"type": "object", "required": ["title", "status"], "properties": {"title": {"type": "string", "minLength": 12, "maxLength": 40}, "status": {"type": "integer", "minimum": 200, "maximum": 299}, "kind": {"type": "string", "enum": ["html", "markdown"]}}}
TEMPLATE = "https://find.test/{kind}/{title}?q={title}"
WANTED = [{"name": "title", "required": True}, {"name": "price", "type": "number"}]


def ext5_fingerprints(spark, d):
    """Fields that one asks of each kind of content, as one text."""
    s = table(spark, d, "scrapes").select("content_type").where("content_type is not null").distinct()
    return s.select("content_type", X.fingerprint(F.array(F.lit("url"), F.col("content_type"), F.lit("title")), F.array(F.lit(None).cast("string"), F.lit("number"), F.lit("text"))).alias("fingerprint"))


def ext6_schema_keys(spark, d):
    s = table(spark, d, "scrapes").where("url is not null and content_type is not null").select("url", "content_type").distinct().join(ext4_signature(spark, d), "url")
    fields = X.fingerprint(F.array(F.col("content_type"), F.lit("price")), F.array(F.lit("text"), F.lit("number")))
    return s.select("signature", "content_type", X.schema_key(F.col("signature"), fields).alias("schema_key")).distinct()


def ext9_self_heal(spark, d):
    """Records of each page by the cached schema of its signature, or a derived one; how it went."""
    pages = table(spark, d, "pages").where("content_type = 'html' and html is not null and url is not null").select("page_id", "url", "html").distinct()
    keyed = pages.withColumn("key", X.schema_key(F.concat(U.host(F.col("url")), U.path(F.col("url"))), F.lit("price:number,title:text")))
    cache = keyed.where("page_id % 2 = 0").select("key", F.lit(json.dumps({"baseSelector": "body", "fields": [{"name": "title", "selector": "h1", "type": "text"}]})).alias("schema")).distinct()
    return P.healed(keyed.join(cache, "key", "left"), WANTED, lambda html: {"fields": [{"name": "title", "selector": "title"}, {"name": "price", "selector": "td:nth-child(3)", "type": "number"}]})


def ext11_merged(spark, d):
    """Partial results of each document's lines as one: lengths chained, the first head that isn't empty."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("part_no", "line"))
    parts = lines.select("doc_id", "part_no", F.to_json(F.struct(F.array(F.length("line")).alias("lengths"), F.trim("line").alias("head"))).alias("data"))
    shape = F.from_json("data", "lengths array<int>, head string")
    return X.merged(parts, "doc_id", "part_no").select("doc_id", shape.alias("x")).select("doc_id", F.array_join("x.lengths", ",").alias("lengths"), "x.head")


def ext12_invalid(spark, d):
    """Errors of each scrape as a record against a schema."""
    s = _scrapes(spark, d).select("scrape_id", F.to_json(F.struct("title", "status", F.col("content_type").alias("kind"))).alias("data"))
    return P.checked(s, "scrape_id", "data", SCHEMA).select("scrape_id", F.size("errors").alias("errors"))


def ext13_prompts(spark, d):
    s = _scrapes(spark, d)
    return s.select("scrape_id", F.sha2(X.prompt(F.col("content"), F.col("title"), F.coalesce("url", F.lit("")), SCHEMA, "Keep names"), 256).alias("prompt"))


def _answers(spark, d):
    t = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("t")))
    return _scrapes(spark, d).select("scrape_id", F.when(F.col("scrape_id") % 3 == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(F.col("scrape_id") % 3 == 1, t).otherwise(F.col("title")).alias("answer"))


def ext14_answers(spark, d):
    """Answers that hold JSON, fenced or not, and what it says."""
    bare = F.regexp_replace(F.trim("answer"), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    ok = bare.rlike(r"^[{\[]") & F.try_parse_json(bare).isNotNull()
    return _answers(spark, d).select("scrape_id", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.get_json_object(bare, "$.t")).alias("t"))


def ext15_graded(spark, d):
    """Records with texts, numbers and lists against the content they come from."""
    words = F.slice(F.split("title", " "), 1, 3)
    s = _scrapes(spark, d).where("content is not null").select("scrape_id", "content", F.to_json(F.struct("title", "status", words.alias("words"))).alias("data"))
    return X.graded(s, "scrape_id", "data", "content").select("scrape_id", "overall", F.array_join("suspect", ",").alias("suspect"), F.array_join("missing", ",").alias("missing"))


def ag9_mean_confidence(spark, d):
    """Mean confidence of the titles of a site."""
    s = _scrapes(spark, d).withColumn("site", T.site_of(F.col("url"))).where("site is not null")
    t, c = T.normalise_for_grounding(F.col("title")), T.normalise_for_grounding(F.coalesce("content", F.lit("")))
    words = F.filter(F.split("t", " "), lambda w: F.length(w) > 2)
    hit = F.size(F.filter(words, lambda w: F.col("c").contains(w)))
    grounded = (F.length("t") < 2) | F.col("c").contains(F.col("t")) | (F.size(words) == 0) | (hit >= F.size(words) * F.lit(0.6))
    score = F.when(F.coalesce("title", F.lit("")) == "", 0).when(grounded, 9).otherwise(3)
    return s.select("site", "title", t.alias("t"), c.alias("c")).groupBy("site").agg((F.sum(score) / F.count("*") / 10).alias("confidence"))


def ext16_sources(spark, d):
    """Pages asked for, the first 20 known ones among them: whether each gave data, and why not."""
    asked = table(spark, d, "crawl_jobs").where("url is not null").select("url").distinct().orderBy("url").limit(20)
    got = table(spark, d, "scrapes").groupBy("url").agg(F.bool_or(F.col("error").isNull()).alias("ok"), F.max("error").alias("error"))
    return asked.join(got, "url", "left").select("url", F.coalesce("ok", F.lit(False)).alias("success"), F.when(F.coalesce("ok", F.lit(False)), None).otherwise(F.coalesce("error", F.lit("not scraped"))).alias("error"))


def ext17_names(spark, d):
    n = F.regexp_replace(F.lower("title"), " ", "_")
    return _scrapes(spark, d).where("title is not null").select("scrape_id", n.alias("name"), X.valid_name(n).alias("valid"))


def ext19_templates(spark, d):
    url, error = X.resolved(TEMPLATE, {"kind": F.col("content_type"), "title": F.col("title")})
    return _scrapes(spark, d).select("scrape_id", url.alias("resolved"), error.alias("problem"))


def _specs(spark, d):
    """A store of saved extractions: each host's pages of each day as versions of one."""
    s = _scrapes(spark, d).withColumn("site", T.site_of(F.col("url"))).where("site is not null and scraped_at is not null")
    return s.groupBy("site", F.to_date("scraped_at").alias("day")).agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col("title"), F.lit("")) != "").alias("titled")).select(
        F.regexp_replace("site", "[^a-z0-9]", "_").alias("name"), F.date_format("day", "yyyy-MM-dd").alias("version"), F.when(F.col("titled") * 2 >= F.col("records"), "healthy").otherwise("broken").alias("health"), F.when(F.col("records") > 2, "s1").alias("session_id"))


def ext21_store(spark, d):
    """The latest version of each saved extraction."""
    return latest(_specs(spark, d).where(X.valid_name(F.col("name"))), "name", "version")


def ext20_summaries(spark, d):
    return X.spec_summary(ext21_store(spark, d))


def ag14_verified(spark, d):
    """Outcome of a run over all saved extractions."""
    return ext21_store(spark, d).agg(F.count("*").alias("checked"), F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_if(F.col("health") != "healthy").alias("broken"))


def prj19_reports(spark, d):
    rows = P.extract(table(spark, d, "pages").where("content_type = 'html'").select("page_id", "url", "html").distinct(), ARTICLE, keys=("page_id", "url"))
    return P.reported(rows.select("page_id", "url", F.to_json(F.get("records", 0)).alias("data")), "page_id", "url", "data")


QUERIES = {f.__name__: f for f in (ext5_fingerprints, ext6_schema_keys, ext9_self_heal, ext11_merged, ext12_invalid, ext13_prompts, ext14_answers, ext15_graded, ag9_mean_confidence, ext16_sources, ext17_names, ext19_templates, ext20_summaries, ext21_store, ag14_verified, prj19_reports)}

_PROMPT = json.dumps(SCHEMA, indent=2).replace("'", "''")
_SPECS = _S + f""", r AS (SELECT {_SITE} AS site, strftime(scraped_at, '%Y-%m-%d') AS version, count(*) AS n, count(*) FILTER (coalesce(title, '') <> '') AS t FROM s WHERE scraped_at IS NOT NULL GROUP BY ALL),
p AS (SELECT regexp_replace(site, '[^a-z0-9]', '_', 'g') AS name, version, CASE WHEN t * 2 >= n THEN 'healthy' ELSE 'broken' END AS health, CASE WHEN n > 2 THEN 's1' END AS session_id FROM r WHERE site IS NOT NULL),
o AS (SELECT * FROM p WHERE regexp_full_match(name, '[a-z0-9_]{{1,48}}') QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1)
"""
_ENC = lambda c: _component(f"url_encode({c})")
SQL = {
    "ext5_fingerprints": "SELECT DISTINCT content_type, array_to_string(list_sort(['url:text', content_type || ':number', 'title:text']), ',') AS fingerprint FROM scrapes WHERE content_type IS NOT NULL",
    "ext6_schema_keys": f"SELECT DISTINCT signature, content_type, 'selfheal:' || left(sha256(signature || '::' || array_to_string(list_sort([content_type || ':text', 'price:number']), ',')), 40) AS schema_key FROM (SELECT {_SIG} AS signature, content_type FROM scrapes WHERE url IS NOT NULL AND content_type IS NOT NULL)",
    "ext11_merged": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: length(x)), ',') AS lengths, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '') AS head FROM documents WHERE text IS NOT NULL",
    "ext12_invalid": _S + "SELECT scrape_id, CAST(CASE WHEN title IS NULL THEN 1 WHEN length(title) < 12 OR length(title) > 40 THEN 1 ELSE 0 END + CASE WHEN status IS NULL OR status < 200 OR status > 299 THEN 1 ELSE 0 END + CASE WHEN content_type NOT IN ('html', 'markdown') THEN 1 ELSE 0 END AS INTEGER) AS errors FROM s",
    "ext13_prompts": _S + f"SELECT scrape_id, sha256('I need to extract information from the following web content from ' || coalesce(url, '') || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ' with title \"' || title || '\"' END || ' and return it as JSON:' || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || 'Please extract information using this JSON schema:' || chr(10) || '{_PROMPT}' || chr(10) || chr(10) || 'Additional instructions: Keep names and format as JSON') AS prompt FROM s",
    "ext14_answers": _S + "SELECT scrape_id, CASE WHEN scrape_id % 3 < 2 THEN true ELSE coalesce(regexp_matches(trim(title, ' '), '^[{\\[]') AND json_valid(trim(title, ' ')), false) END AS ok, CASE WHEN scrape_id % 3 < 2 THEN coalesce(title, '') END AS t FROM s",
    "ag9_mean_confidence": _S + f", n AS (SELECT {_SITE} AS site, title, {_plain('title')} AS t, {_plain('coalesce(content, chr(32))')} AS c FROM s), w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: length(x) > 2) AS w FROM n WHERE site IS NOT NULL) SELECT site, sum(CASE WHEN coalesce(title, '') = '' THEN 0 WHEN length(t) < 2 OR contains(c, t) OR len(w) = 0 OR len(list_filter(w, lambda x: contains(c, x))) >= len(w) * 0.6::DOUBLE THEN 9 ELSE 3 END)::DOUBLE / count(*) / 10 AS confidence FROM w GROUP BY site",
    "ext16_sources": "WITH a AS (SELECT DISTINCT url FROM crawl_jobs WHERE url IS NOT NULL ORDER BY url LIMIT 20), g AS (SELECT url, bool_or(error IS NULL) AS ok, max(error) AS error FROM scrapes GROUP BY url) SELECT url, coalesce(ok, false) AS success, CASE WHEN coalesce(ok, false) THEN NULL ELSE coalesce(error, 'not scraped') END AS error FROM a LEFT JOIN g USING (url)",
    "ext17_names": _S + "SELECT scrape_id, replace(lower(title), ' ', '_') AS name, regexp_full_match(replace(lower(title), ' ', '_'), '[a-z0-9_]{1,48}') AS valid FROM s WHERE title IS NOT NULL",
    "ext19_templates": _S + f", e AS (SELECT scrape_id, CASE WHEN coalesce(content_type, '') = '' THEN 'missing required URL parameter: kind' WHEN coalesce(title, '') = '' THEN 'missing required URL parameter: title' END AS problem, {_ENC('content_type')} AS k, {_ENC('title')} AS t FROM s) SELECT scrape_id, CASE WHEN problem IS NULL THEN 'https://find.test/' || k || '/' || t || '?q=' || t END AS resolved, problem FROM e",
    "ext21_store": _SPECS + "SELECT * FROM o",
    "ext20_summaries": _SPECS + "SELECT name, health, session_id IS NOT NULL AS session_bound FROM o",
    "ag14_verified": _SPECS + "SELECT count(*) AS checked, count(*) FILTER (health = 'healthy') AS healthy, count(*) FILTER (health <> 'healthy') AS broken FROM o",
}
