"""One object over a table of pages: scrape, crawl, batch, map, search, extract, parse, index, usage. And the functions under SQL names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from gleanspark.functions import guards as G
from gleanspark.functions import text as T
from gleanspark.functions import urls as U
from gleanspark.operators import discovery, extraction
from gleanspark.operators.chunker import chunk
from gleanspark.operators.crawl import crawl
from gleanspark.operators.pages import FORMATS, extract, healed, render
from gleanspark.sources import files

PREFIX = "glean_"


def sql_functions() -> dict[str, object]:
    """Outputs of pages and chunks as Arrow functions by their SQL names: (html, url) for outputs, (text, tokens, overlap) for chunks."""

    def output(kind: S.DataType, make) -> object:
        arrow = to_arrow_type(kind)

        @F.arrow_udf(returnType=kind)
        def of_page(html: pa.Array, url: pa.Array) -> pa.Array:
            return pa.array([None if h is None else make(h, u) for h, u in zip(html.to_pylist(), url.to_pylist())], arrow)

        return of_page

    @F.arrow_udf(returnType=S.ArrayType(S.StringType()))
    def chunks(text: pa.Array, most: pa.Array, rate: pa.Array) -> pa.Array:
        return pa.array([chunk(*x) for x in zip(text.to_pylist(), most.to_pylist(), rate.to_pylist())], pa.list_(pa.string()))

    return {PREFIX + name: output(kind, make) for name, (kind, make) in FORMATS.items()} | {PREFIX + "chunks": chunks}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql; their names."""
    made = sql_functions()
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)


class Engine:
    """Answers for a table of pages (url, html, title, content, error ...) what a service answers for the web. All results are lazy DataFrames."""

    def __init__(self, pages: DataFrame, url: str = "url", html: str = "html", complete: Callable[[str], str | None] | None = None):
        self.pages, self.url, self.html, self.complete = pages, url, html, complete
        self.spark = pages.sparkSession

    def _asked(self, urls: Sequence[str]) -> DataFrame:
        """Each address once, in order, with its page if it is known; addresses that may not be asked for have an error."""
        first = list(dict.fromkeys(urls))
        asked = self.spark.createDataFrame(list(enumerate(first)), "ord int, asked string")
        one = self.pages.where(F.col(self.url).isNotNull()).dropDuplicates([self.url])
        u = F.col("asked")
        why = F.when(~G.is_safe_name(u) | G.blocked_request(u), "address is not allowed").when(F.col(self.url).isNull(), "not found")
        return asked.join(one, asked.asked == one[self.url], "left").withColumn("fetch_error", why)

    def scrape(self, urls: Sequence[str], formats: Sequence[str] = ("markdown",)) -> DataFrame:
        """(url, success, error, formats ...) of the addresses, in their order."""
        rows = self._asked(urls).select("ord", F.col("asked").alias("url"), F.when(F.col("fetch_error").isNull(), F.col(self.html)).alias("html"), "fetch_error")
        made = render(rows, formats, keys=("ord", "url", "fetch_error"))
        return made.withColumn("error", F.coalesce("fetch_error", "page_error")).withColumn("success", F.col("error").isNull()).orderBy("ord").drop("ord", "fetch_error", "page_error")

    def batch(self, urls: Sequence[str], formats: Sequence[str] = ("markdown",)) -> tuple[DataFrame, DataFrame]:
        """(results, status): as scrape, and the counts of the whole batch. At most 100 addresses."""
        if not 0 < len(urls) <= 100:
            raise ValueError("a batch has 1 to 100 addresses")
        rows = self.scrape(urls, formats)
        n, bad = F.count("*"), F.count_if(~F.col("success"))
        return rows, rows.agg(n.alias("total"), (n - bad).alias("completed"), bad.alias("failed"), F.when(bad == n, "failed").when(bad > 0, "completed_with_errors").otherwise("completed").alias("status"))

    def links(self) -> DataFrame:
        """(url, link) of all pages."""
        return render(self.pages.where(F.col(self.url).isNotNull()), ["links"], keys=(self.url,), html=self.html, url=self.url).select(F.col(self.url).alias("url"), F.explode("links").alias("link"))

    def crawl(self, request: dict, robots: Sequence[tuple[bool, str]] = ()) -> tuple[DataFrame, DataFrame]:
        """(pages, edges) of a crawl within the request's bounds: links are filtered, allowed by robots rules, and known pages alone are visited."""
        r = discovery.crawl_request(request)
        link, seed = F.col("link"), F.lit(r["url"])
        near = U.child_link(link, seed, r.get("includePaths") or (), r.get("excludePaths") or (), subdomains=bool(r.get("includeSubdomains")))
        edges = self.links().where(near & G.allowed_by(link, robots))
        exists = self.pages.where(F.col(self.url).isNotNull()).select(U.crawl_key(F.col(self.url)).alias("k")).distinct()
        edges = edges.join(exists, U.crawl_key(link) == F.col("k"), "left_semi")
        found = crawl(edges, self.spark.createDataFrame([(r["url"],)], "url string"), r.get("maxDepth", discovery.MAX_DEPTH), r.get("limit", 100), tuple(r.get("keywords") or ()), r.get("strategy", "best_first") == "best_first")
        return found, edges

    def estimate(self, limit: int | None, browser: bool = False, extraction_: bool = False, schema: bool = False) -> DataFrame:
        pages, mode, calls = discovery.estimate(F.lit(limit).cast("int"), F.lit(browser), F.lit(extraction_), F.lit(schema))
        return self.spark.range(1).select(pages.alias("max_pages"), mode.alias("mode"), calls.alias("llm_calls"))

    def discover(self, seed: str, search: str | None = None, limit: int = discovery.MAX_MAP, **filters) -> DataFrame:
        """(url, method, score) of a site's addresses: its pages, the links of all pages, and guesses that are known."""
        own = self.pages.where(F.col(self.url).isNotNull()).select(F.col(self.url).alias("url")).distinct()
        ordered = lambda df: df.select("url", F.xxhash64("url").alias("ord"))
        guessed = discovery.known(discovery.guesses(self.spark.createDataFrame([(seed,)], "u string").select(G.origin(F.col("u")).alias("origin"))).select("url"), own)
        return discovery.discovered([("pages", ordered(own)), ("links", ordered(self.links().select(F.col("link").alias("url")).distinct())), ("commonPaths", ordered(guessed))], seed, search, limit=limit, **filters)[0]

    def search(self, query: str, limit: int | None = None, key: str = "page_id") -> DataFrame:
        return discovery.search_pages(self.pages, query, limit, key)

    def extract_schema(self, schema: dict, keys: Sequence[str] = ("page_id",)) -> DataFrame:
        return extract(self.pages, schema, keys, self.html, self.url)

    def extract_auto(self, wanted: list[dict], schemas: DataFrame | None = None, key: str = "page_id") -> DataFrame:
        """Self-healing extraction; schemas has (signature key, schema as JSON) of what is cached."""
        fields = ",".join(sorted(f"{w['name']}:{w.get('type') or 'text'}" for w in wanted))
        keyed = self.pages.withColumn("_k", extraction.schema_key(F.concat(U.host(F.col(self.url)), U.path(F.col(self.url))), F.lit(fields)))
        rows = keyed.join(schemas.select(F.col("key").alias("_k"), "schema"), "_k", "left") if schemas is not None else keyed.withColumn("schema", F.lit(None).cast("string"))
        complete = self.complete
        derive = (lambda html: extraction.parse_json(complete(html))[1]) if complete else None
        return healed(rows, wanted, derive, key, self.html, "schema")

    def extract_many(self, schema: dict, instructions: str | None = None, key: str = "page_id") -> DataFrame:
        """What the completer makes of each page's text, merged, validated and grounded."""
        if self.complete is None:
            raise ValueError("extraction by a model needs a completer")
        rows = render(self.pages, ["fit_markdown"], keys=(key, self.url), html=self.html, url=self.url)
        return extraction.extract_with(rows.withColumn("title", F.lit("")), self.complete, schema, instructions, key, "fit_markdown", self.url)

    def parse_documents(self, folder: str) -> DataFrame:
        return files.documents(self.spark.read.format("binaryFile").load(folder))

    def reader(self) -> DataFrame:
        """(url, markdown) of all pages."""
        return render(self.pages, ["fit_markdown"], keys=(self.url,), html=self.html, url=self.url).select(F.col(self.url).alias("url"), F.col("fit_markdown").alias("markdown"))

    def llmstxt(self) -> DataFrame:
        """(site, url, line): a line for each page of the index for language models."""
        rows = self.reader().where("url is not null")
        lines = F.filter(F.transform(F.split("markdown", "\n"), T.js_trim), lambda x: (F.length(x) > 30) & ~x.startswith("#") & ~x.startswith("["))
        head = F.regexp_extract("markdown", r"(?m)^#+ (.+)$", 1)
        desc = F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 200)
        return rows.select(T.site_of(F.col("url")).alias("site"), "url", F.concat(F.lit("- ["), F.coalesce(F.nullif(head, F.lit("")), "url"), F.lit("]("), "url", F.lit(")"), F.when(desc == "", "").otherwise(F.concat(F.lit(": "), desc))).alias("line"))

    def tools(self) -> dict[str, Callable]:
        """What may be called by name."""
        return {n: getattr(self, n) for n in ("scrape", "batch", "crawl", "estimate", "discover", "search", "extract_schema", "extract_auto", "extract_many", "parse_documents", "reader", "llmstxt")}
