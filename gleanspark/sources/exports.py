"""Exports of crawls: names, front matter, records, consolidated files, summaries, archives, notices, and what has grown too old."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import urls as U

#: Pages of one archive.
ARCHIVE = 1000


def page_record(url: Column, title: Column, content: Column, metadata: Column) -> Column:
    """The public view of a page; nulls are empty."""
    none = F.lit("")
    return F.struct(F.coalesce(url, none).alias("url"), F.coalesce(title, none).alias("title"), F.coalesce(content, none).alias("markdown"), metadata.alias("metadata"))


def archive_name(url: Column, index: Column, ending: str = "md") -> Column:
    """NNNN_host_path.ending of at most 180 characters."""
    number = F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    words = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9]+", "_")
    path = F.regexp_replace(words(F.concat(U.path(url), F.when(U.query(url) == "", "").otherwise(F.concat(F.lit("?"), U.query(url))))), "^_+|_+$", "")
    return F.when(F.coalesce(U.host(url), F.lit("")) == "", F.concat(number, F.lit(f"_page.{ending}"))).otherwise(F.substring(F.concat(number, F.lit("_"), words(U.host(url)), F.lit("_"), F.when(path == "", "index").otherwise(path), F.lit(f".{ending}")), 1, 180))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with index, from 0 within each key. Only keys and orders travel to be numbered."""
    w = Window.partitionBy(key).orderBy(order)
    slim = rows.select(F.col(key), F.col(order)).distinct().withColumn("index", F.row_number().over(w) - 1)
    return rows.join(slim, [key, order])


def front_matter(url: Column, title: Column, at: Column, content: Column) -> Column:
    """A page as a file: its address, title and time ahead of the text."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    return F.concat(F.lit("---\nurl: "), quoted(url), F.lit("\ntitle: "), quoted(title), F.lit("\nexported_at: "), quoted(at), F.lit("\n---\n\n"), F.coalesce(content, F.lit("")))


def parsed_matter(text: Column) -> tuple[Column, Column, Column]:
    """(metadata map, title, rest of the text) of a file; no closed front matter gives none, null and the whole text.

    Values lose quotes around them, keys are words, and the last of equal keys holds. The title is the first title line that isn't empty.
    """
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(lines, 2, 1_000_000_000), "---")
    head = F.when(text.startswith("---\n") & (end > 0), F.slice(lines, 2, (end - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    unquoted = lambda v: F.when((F.length(v) > 1) & v.startswith('"') & v.endswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    pairs = F.transform(F.filter(head, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquoted(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"].rlike("^[A-Za-z0-9_]+$"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    title = F.try_element_at(F.filter(F.transform(F.filter(head, lambda x: x.startswith("title: ")), lambda x: unquoted(F.trim(F.substring(x, F.lit(8), F.length(x))))), lambda t: t != ""), F.lit(1))
    rest = F.when(F.size(head) > 0, F.array_join(F.slice(lines, (end + 2).cast("int"), F.size(lines)), "\n")).otherwise(text)
    return F.map_from_entries(last), title, F.when(text.startswith("---\n") & (end == 1), F.array_join(F.slice(lines, 3, F.size(lines)), "\n")).otherwise(rest)


def consolidated(pages: DataFrame, key: str = "crawl_id", order: str = "scrape_id", title: str = "title", text: str = "content") -> DataFrame:
    """(key, part_no, part): one file per crawl in parts, a head and a section per page, as large as it may be."""
    n = pages.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(0).alias("part_no"), F.concat(F.lit("# Consolidated Crawl Results\n\n**Crawl ID:** "), F.col(key), F.lit("\n**Total Files:** "), F.col("n").cast("string"), F.lit("\n\n---\n\n")).alias("part"))
    body = numbered(pages, key, order).select(key, (F.col("index") + 1).alias("part_no"), F.concat(F.lit("## "), F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit("page "), F.col(order).cast("string"))), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n\n---\n\n")).alias("part"))
    return n.unionByName(body)


def summary(pages: DataFrame, key: str = "crawl_id", at: str = "scraped_at", url: str = "url", failed: str = "error") -> DataFrame:
    """(key, text): counts and times of each crawl as markdown. The list of its files is a table of its own."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    g = pages.groupBy(key).agg(F.min(F.struct(at, url))[url].alias("first"), stamp(F.min(at)).alias("began"), stamp(F.max(at)).alias("ended"), F.count("*").alias("n"), F.count_if(F.col(failed).isNull()).alias("ok"))
    line = lambda name, c: F.concat(F.lit(f"**{name}:** "), F.coalesce(c.cast("string"), F.lit("")))
    parts = [F.lit("# Crawl Summary"), F.lit(""), line("Crawl ID", F.col(key)), line("Initial URL", F.col("first")), line("Start Time", F.col("began")), line("End Time", F.col("ended")), line("Total Pages", F.col("n")), line("Successful", F.col("ok")), line("Failed", F.col("n") - F.col("ok"))]
    return g.select(key, F.concat_ws("\n", *parts).alias("text"))


def archives(pages: DataFrame, key: str = "crawl_id", order: str = "scrape_id", url: str = "url", title: str = "title", text: str = "content") -> DataFrame:
    """(key, archive_no, pages, data): ZIP archives of at most ARCHIVE pages each, with a manifest in each of them."""
    kind = pages.schema[key].dataType.simpleString()
    rows = numbered(pages, key, order).select(F.col(key).alias("k"), F.floor(F.col("index") / ARCHIVE).cast("int").alias("no"), "index", archive_name(F.col(url), F.col("index")).alias("file"), F.col(url).alias("url"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(t: pa.Table) -> pa.Table:
        held, data = sorted(t.to_pylist(), key=lambda r: r["index"]), io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for r in held:
                z.writestr(zipfile.ZipInfo(r["file"]), r["text"])
            listed = [{"url": r["url"], "title": r["title"], "file": r["file"]} for r in held]
            z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps({"crawlId": held[0]["k"], "count": len(held), "pages": listed}, indent=2, ensure_ascii=False))
        return pa.table({key: t.column("k").slice(0, 1), "archive_no": t.column("no").slice(0, 1), "pages": pa.array([len(held)], pa.int32()), "data": pa.array([data.getvalue()], pa.binary())})

    return rows.groupBy("k", "no").applyInArrow(pack, f"{key} {kind}, archive_no int, pages int, data binary")


def notices(events: DataFrame, event: str, data: Sequence[str] | None = None, at: str | None = None) -> DataFrame:
    """(payload): what a webhook is told about each row, as JSON text."""
    names = list(data) if data is not None else [c for c in events.columns if c != at]
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if at else F.lit(None).cast("string")
    return events.select(F.to_json(F.struct(F.lit(event).alias("event"), F.struct(*names).alias("data"), stamp.alias("timestamp"))).alias("payload"))


def notify(stream: DataFrame, send: Callable[[str], None], checkpoint: str, event: str):
    """A query that hands the notices of each micro-batch to send, on the executors; a failed batch is sent again."""

    def each(rows):
        for r in rows:
            send(r.payload)

    def batch(df: DataFrame, _: int) -> None:
        notices(df, event).foreachPartition(each)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(files: DataFrame, now: Column, days: int = 7, at: str = "modificationTime") -> DataFrame:
    """Files older than so many days."""
    return files.where(F.col(at) < now - F.make_interval(days=F.lit(days)))


def write_pages(pages: DataFrame, folder: str, key: str = "crawl_id", text: str = "file_text") -> None:
    """Exported pages as text, a folder per crawl."""
    pages.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n\f\n").text(folder)


def write_records(pages: DataFrame, folder: str, key: str = "crawl_id") -> None:
    """Exported records as lines of JSON, a folder per crawl."""
    pages.write.mode("overwrite").partitionBy(key).json(folder)
