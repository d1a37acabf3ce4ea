"""Sources and sinks beside tables: documents as bytes, site maps, exports and snapshots that expire."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import urls as U
from gleanspark.html import ops
from gleanspark.session import checkpointed

MAX_BYTES = 25 * 1024 * 1024


def kind_of(content, hint=None):
    """pdf, docx or html: by the hint, else by the first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    seen = F.when(head.startswith("%pdf-"), "pdf").when(head.startswith("pk"), "docx").otherwise("html")
    return seen if hint is None else F.coalesce(F.when(F.lower(hint).isin("pdf", "docx", "html"), F.lower(hint)), seen)


def documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, kind, text, error) of files read as bytes. PDF bodies and files over the limit give an error."""

    def one(kind: str, data: bytes) -> tuple[str | None, str | None]:
        if len(data) > MAX_BYTES:
            return None, "file too large"
        if kind == "pdf":
            return None, "pdf bodies aren't supported"
        try:
            if kind == "docx":
                tree = ElementTree.fromstring(zipfile.ZipFile(BytesIO(data)).read("word/document.xml"))
                w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
                return "\n\n".join(t for p in tree.iter(w + "p") if (t := "".join(x.text or "" for x in p.iter(w + "t")))), None
            return ops.markdown(data.decode("utf-8", "replace")), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(k, d) for k, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], ["path", "kind", "text", "error"])

    return files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), kind_of(F.col(content)).alias("kind"), F.col(content).alias("content")).mapInArrow(run, "path string, kind string, text string, error string")


def unzipped(files: DataFrame, content: str = "content") -> DataFrame:
    """files with body: the bytes as text, unpacked first where they are gzip; null where that fails."""
    import gzip

    names = [c for c in files.columns if c != content]

    def text(data: bytes | None) -> str | None:
        try:
            return None if data is None else (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([text(x) for x in b.columns[-1].to_pylist()], pa.string())], [*names, "body"])

    kinds = ", ".join(f"`{n}` {files.schema[n].dataType.simpleString()}" for n in names)
    return files.select(*names, content).mapInArrow(run, f"{kinds}, body string")


def _locations(body):
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_urls(maps: DataFrame, url: str = "url", body: str = "body", depth: int = 5, starts: DataFrame | None = None) -> DataFrame:
    """(url): valid addresses of site maps, given as a table of their bodies; indexes lead to other rows of it.

    Levels are at most depth, and a map is read once, so cycles end. Bodies are XML or lines of text. Without starts, all
    maps are read that no other leads to.
    """
    rows = maps.select(F.col(url).alias("m"), F.col(body).alias("b")).where("b is not null")
    is_index = F.col("b").rlike(r"(?i)<sitemapindex[\s>]")
    found = rows.select("m", is_index.alias("index"), F.explode(F.when(F.col("b").rlike(r"(?i)<(urlset|sitemapindex)[\s>]"), _locations(F.col("b"))).otherwise(F.transform(F.split("b", r"\r?\n"), F.trim))).alias("u")).where(U.is_valid(F.col("u")))
    # Indexes alone are followed level by level; the pages of all maps that were reached are read once at the end.
    edges = checkpointed(found.where("index").select("m", "u").distinct())
    children = edges.select(F.col("u").alias("m")).distinct()
    front = rows.select("m").distinct().join(children, "m", "left_anti") if starts is None else starts.select(F.col("url").alias("m")).distinct()
    seen = front = checkpointed(front)
    for _ in range(depth - 1):
        front = checkpointed(edges.join(front, "m").select(F.col("u").alias("m")).distinct().join(seen, "m", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found.where("not index").join(seen, "m", "left_semi").select(F.col("u").alias("url")).distinct()


def sitemap_entries(maps: DataFrame, body: str = "body") -> DataFrame:
    """(url, lastmod, changefreq, priority) of the entries of url sets; what an entry lacks is null."""
    entry = F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1)))
    tag = lambda n: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{n}>\s*(.*?)\s*</{n}>", 1)), F.lit(""))
    rows = maps.select(entry.alias("e")).select(F.try_element_at(_locations(F.col("e")), F.lit(1)).alias("url"), tag("lastmod").alias("lastmod"), tag("changefreq").alias("changefreq"), tag("priority").try_cast("double").alias("priority"))
    return rows.where(U.is_valid(F.col("url")))


def robots_sitemaps(robots: DataFrame, body: str = "body") -> DataFrame:
    """(url): addresses of Sitemap lines, in any case."""
    lines = robots.select(F.explode(F.split(F.col(body), r"\r?\n")).alias("l")).select(F.trim("l").alias("l")).where(F.lower("l").startswith("sitemap:"))
    return lines.select(F.trim(F.substring("l", 9, 1_000_000)).alias("url")).where(U.is_valid(F.col("url"))).distinct()


def alive(cache: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """Cached rows that haven't expired at a time; rows without one never do."""
    return cache.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now)))


def label_key(labels):
    """Labels in order as {name="value",...}, with backslashes, quotes and line ends escaped; '' where there are none."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise("")


def metrics_text(rows: DataFrame) -> DataFrame:
    """(line): counters of (name, labels map, value), added up per series."""
    return rows.groupBy("name", label_key(F.col("labels")).alias("key")).agg(F.sum("value").alias("v")).select(F.concat("name", "key", F.lit(" "), F.col("v").cast("string")).alias("line"))


def metrics(counters: DataFrame | None = None, gauges: DataFrame | None = None, observed: DataFrame | None = None, buckets: tuple = (0.1, 0.5, 1, 5, 10, 30, 60)) -> DataFrame:
    """(line): a line for the type of each metric and its series. Counters are added up, gauges are as given, observations fall into cumulative buckets."""
    out = []
    for rows, kind in ((counters, "counter"), (gauges, "gauge"), (observed, "histogram")):
        if rows is not None:
            out.append(rows.select("name").distinct().select(F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}")).alias("line")))
    if counters is not None:
        out.append(metrics_text(counters))
    if gauges is not None:
        out.append(gauges.select(F.concat("name", label_key(F.col("labels")), F.lit(" "), F.col("value").cast("string")).alias("line")))
    if observed is not None:
        g = observed.groupBy("name", label_key(F.col("labels")).alias("key")).agg(F.array(*[F.count_if(F.col("value") <= b) for b in buckets], F.count("*")).alias("n"), F.sum("value").alias("sum"))
        inner = F.when(F.col("key") == "", "").otherwise(F.concat(F.substring(F.col("key"), F.lit(2), F.length("key") - 2), F.lit(",")))
        at = F.array(*[F.lit(str(b)) for b in buckets], F.lit("+Inf"))
        lines = F.concat(F.zip_with(at, "n", lambda b, n: F.concat("name", F.lit("_bucket{"), inner, F.lit('le="'), b, F.lit('"} '), n.cast("string"))), F.array(F.concat("name", F.lit("_sum"), "key", F.lit(" "), F.col("sum").cast("string")), F.concat("name", F.lit("_count"), "key", F.lit(" "), F.element_at("n", -1).cast("string"))))
        out.append(g.select(F.explode(lines).alias("line")))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def slug(name: str) -> bool:
    """Whether a name of a saved extraction is valid."""
    return re.fullmatch(r"[a-z0-9_]{1,48}", name) is not None
