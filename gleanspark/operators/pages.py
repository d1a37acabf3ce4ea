"""Pages to columns, in one pass over Arrow batches, for whatever outputs are asked. Outputs that only read a page share its tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from gleanspark.html import cleaning, ops
from gleanspark.operators import extraction

_TABLE = S.StructType([S.StructField("caption", S.StringType()), S.StructField("headers", S.ArrayType(S.StringType())), S.StructField("rows", S.ArrayType(S.ArrayType(S.StringType()))), S.StructField("row_count", S.IntegerType()), S.StructField("column_count", S.IntegerType())])
#: Outputs by name: their type, and how they are made of a page's HTML and address.
FORMATS = {
    "text": (S.StringType(), lambda h, u: ops.text_of(h)),
    "markdown": (S.StringType(), lambda h, u: ops.markdown(h)),
    "fit_html": (S.StringType(), lambda h, u: ops.fit_html(h)),
    "fit_markdown": (S.StringType(), lambda h, u: ops.markdown(h, fit=True)),
    "links": (S.ArrayType(S.StringType()), ops.links),
    "tables": (S.ArrayType(_TABLE), lambda h, u: ops.tables(h)),
    "contacts": (S.StructType([S.StructField("emails", S.ArrayType(S.StringType())), S.StructField("phones", S.ArrayType(S.StringType())), S.StructField("socials", S.MapType(S.StringType(), S.StringType()))]), ops.contacts),
}
_LINKS = S.ArrayType(S.StringType())
_RESULT = S.StructType([S.StructField("title", S.StringType()), S.StructField("url", S.StringType()), S.StructField("snippet", S.StringType()), S.StructField("position", S.IntegerType())])
FORMATS |= {
    "raw_html": (S.StringType(), lambda h, u: h),
    "clean_html": (S.StringType(), lambda h, u: cleaning.clean_html(h)),
    "text_only": (S.StringType(), lambda h, u: cleaning.text_only(h)),
    "legacy_links": (_LINKS, cleaning.legacy_links),
    "visible_links": (_LINKS, cleaning.visible_links),
    "labelled_links": (S.ArrayType(S.StructType([S.StructField("text", S.StringType()), S.StructField("url", S.StringType())])), cleaning.labelled_links),
    "sample": (S.StringType(), lambda h, u: cleaning.sample(h)),
    "search_results": (S.ArrayType(_RESULT), lambda h, u: cleaning.search_results(h, 10)),
}
_FIELD = {"text": S.StringType(), "attribute": S.StringType(), "html": S.StringType(), "number": S.DoubleType(), "list": S.ArrayType(S.StringType())}


def _apply(pages: DataFrame, keys: Sequence[str], html: str, url: str, fields: list[S.StructField], make) -> DataFrame:
    out = S.StructType([pages.schema[k] for k in keys] + fields + [S.StructField("page_error", S.StringType())])
    arrow = to_arrow_schema(out)
    rows = pages.select(*keys, pages[html].alias("_h"), pages[url].alias("_u"))

    def tried(f, h, u) -> tuple[object, str | None]:
        try:
            return f(h, u), None
        except Exception as e:  # a page that breaks an output is data, not a failed job
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, errors = [], []
            for h, u in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()):
                got = [tried(f, h, u) for f in make] if h is not None else [(None, None)] * len(make)
                made.append([x for x, _ in got])
                errors.append("; ".join(e for _, e in got if e) or None)
            cols = [b.column(k) for k in range(len(keys))]
            cols += [pa.array([m[k] for m in made], arrow.field(len(keys) + k).type) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], schema=arrow)

    return rows.mapInArrow(run, out)


def render(pages: DataFrame, formats: Sequence[str], keys: Sequence[str] = ("page_id",), html: str = "html", url: str = "url") -> DataFrame:
    """keys, one column per format, and page_error. Unknown formats are an error at once; null HTML gives nulls."""
    names = list(dict.fromkeys(f.lower() for f in formats))
    if unknown := [f for f in names if f not in FORMATS]:
        raise ValueError(f"unknown formats: {unknown}")
    return _apply(pages, keys, html, url, [S.StructField(f, FORMATS[f][0]) for f in names], [FORMATS[f][1] for f in names])


def schema_type(fields: list[dict]) -> S.StructType:
    """The type of records of a schema; unknown kinds are strings that stay null."""

    def one(f: dict) -> S.DataType:
        if f.get("type") in ("nested", "nested_list"):
            inner = schema_type(f.get("fields") or [])
            return S.ArrayType(inner) if f["type"] == "nested_list" else inner
        return _FIELD.get(f.get("type"), S.StringType())

    return S.StructType([S.StructField(f["name"], one(f)) for f in fields])


def extract(pages: DataFrame, schema: dict, keys: Sequence[str] = ("page_id",), html: str = "html", url: str = "url") -> DataFrame:
    """keys, records (an array of the schema's struct) and page_error."""
    kind = S.ArrayType(schema_type(schema.get("fields") or []))
    return _apply(pages, keys, html, url, [S.StructField("records", kind)], [lambda h, u: ops.extract(h, schema)])


def _passed(rows: DataFrame, columns: Sequence[str], out: str, names: Sequence[str], make) -> DataFrame:
    """The first column and what make gives for all of them, a tuple of the further output columns."""
    arrow = to_arrow_schema(S.StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], arrow.field(k + 1).type) for k in range(len(names)))], [columns[0], *names])

    return rows.select(*columns).mapInArrow(run, out)


def healed(pages: DataFrame, wanted: list[dict], derive=None, key: str = "page_id", html: str = "html", schema: str = "schema") -> DataFrame:
    """(key, source, healed, healthy, degraded, record_count, ratio, error) of self-healing extraction; schema holds the cached one as JSON, or null."""
    kind = pages.schema[key].dataType.simpleString()

    def one(h: str | None, s: str | None) -> tuple:
        got = extraction.self_heal(h, wanted, cached=extraction.parse_json(s)[1], derive=derive)
        return tuple(got.get(k) for k in ("source", "healed", "healthy", "degraded", "record_count", "ratio", "error"))

    return _passed(pages, [key, html, schema], f"{key} {kind}, source string, healed boolean, healthy boolean, degraded boolean, record_count int, ratio double, error string", ("source", "healed", "healthy", "degraded", "record_count", "ratio", "error"), one)


def checked(rows: DataFrame, key: str, data: str, schema: dict) -> DataFrame:
    """(key, errors) of data as JSON text against a JSON schema. What is no JSON is checked as null."""
    kind = rows.schema[key].dataType.simpleString()
    return _passed(rows, [key, data], f"{key} {kind}, errors array<string>", ["errors"], lambda d: (extraction.validate(extraction.parse_json(d)[1], schema),))


def reported(rows: DataFrame, key: str, url: str, data: str) -> DataFrame:
    """(key, report) of extracted objects as JSON text; the title is the data's own."""
    kind = rows.schema[key].dataType.simpleString()

    def one(u: str | None, d: str | None) -> tuple:
        value = extraction.parse_json(d)[1] or {}
        return (extraction.report(u or "", value.get("title"), value),)

    return _passed(rows, [key, url, data], f"{key} {kind}, report string", ["report"], one)
