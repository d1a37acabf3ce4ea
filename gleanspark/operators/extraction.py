"""Around structured extraction: schemas and their keys, self-healing, partial results, validation, grounding, reports, prompts, templates.

Values travel as JSON text. What a language model does is a callable that the caller brings.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.text import JS_WS_CHARS, JS_WS_PY
from gleanspark.html import ops
from gleanspark.operators.chunker import chunk, tokens

# Fixed values.
CSS_TYPES = ("text", "attribute", "html", "number", "list", "nested", "nested_list")
HEALTHY, GROUNDED, LOW, HIGH = 0.5, 0.6, 0.3, 0.9
CHUNK_BEYOND = 15000
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
_BLANK = f"[{JS_WS_CHARS}]"


def fingerprint(names: Column, kinds: Column) -> Column:
    """name:type of wanted fields in order, joined by commas; null types are text."""
    return F.array_join(F.array_sort(F.zip_with(names, kinds, lambda n, k: F.concat(n, F.lit(":"), F.coalesce(k, F.lit("text"))))), ",")


def schema_key(signature: Column, fields: Column) -> Column:
    return F.concat(F.lit("selfheal:"), F.substring(F.sha2(F.concat(signature, F.lit("::"), fields), 256), 1, 40))


def populated(value) -> bool:
    return value is not None and value != "" and (not isinstance(value, list | dict) or len(value) > 0)


def yield_of(records: Sequence[dict], required: Sequence[str]) -> dict:
    """Whether records look healthy: each required field in half of them or more; any value at all where none is required."""
    n = len(records)
    if required and n:
        ratio = min(sum(populated(r.get(f)) for r in records) for f in required) / n
    else:
        ratio = float(any(populated(v) for r in records for v in r.values()))
    return {"healthy": n > 0 and ratio >= HEALTHY, "record_count": n, "ratio": ratio}


def coerce_schema(raw, wanted: Sequence[dict]) -> dict | None:
    """A valid schema of what a model answered: wanted fields only, known types, an attribute where one is needed. None if nothing is left."""
    by_name = {w["name"]: w for w in wanted}
    if not isinstance(raw, dict):
        return None
    fields = []
    for f in raw.get("fields") if isinstance(raw.get("fields"), list) else []:
        if isinstance(f, dict) and isinstance(f.get("name"), str) and (want := by_name.get(f["name"])):
            kind = f["type"] if f.get("type") in CSS_TYPES else want.get("type") or "text"
            extra = {"attribute": f.get("attribute") or want.get("attribute") or "href"} if kind == "attribute" else {}
            fields.append({"name": f["name"], "selector": f["selector"] if isinstance(f.get("selector"), str) else "", "type": kind} | extra)
    base = raw.get("baseSelector")
    return {"name": "self-healed", "baseSelector": base.strip() if isinstance(base, str) and base.strip() else "body", "fields": fields} if fields else None


def self_heal(html: str | None, wanted: Sequence[dict], provided: dict | None = None, cached: dict | None = None, derive: Callable[[str], dict | None] | None = None, again: bool = False) -> dict:
    """Records by the provided schema, else the cached one; where they look broken, or there is none, by a derived one.

    The source says which it was, healed that a broken one was replaced, degraded that it could not be.
    """
    if not html or not wanted:
        return {"success": False, "error": "no HTML to extract from" if not html else "at least one field is required"}
    required = [w["name"] for w in wanted if w.get("required")]
    known = [] if again else [(s, k) for s, k in ((provided, "provided"), (cached, "cache")) if s][:1]
    result = {}
    for schema, source in known:
        records = ops.extract(html, schema)
        result = {"success": True, "records": records, "schema": schema, "source": source, "healed": False, "degraded": False} | yield_of(records, required)
        if result["healthy"]:
            return result
    schema = coerce_schema(derive(html), wanted) if derive else None
    if schema is None:
        return result | {"degraded": True, "ratio": 0.0} if result else {"success": False, "error": "no schema is known and none can be derived"}
    records = ops.extract(html, schema)
    return {"success": True, "records": records, "schema": schema, "source": "healed" if known else "derived", "healed": bool(known), "degraded": False} | yield_of(records, required)


def parse_json(text: str | None):
    """(whether it is JSON, value) of an answer, fenced or not. Only objects and arrays count."""
    if text is None:
        return False, None
    bare = text.strip()
    if m := _FENCE.fullmatch(bare):
        bare = m[1].strip()
    try:
        return (True, json.loads(bare)) if bare[:1] in ("{", "[") else (False, None)
    except ValueError:
        return False, None


def merge(parts: Sequence):
    """One result of the partial ones: texts joined, arrays chained, objects united, the first value that isn't empty held; else the first."""
    kinds = {type(p) for p in parts}
    if len(parts) < 2 or kinds not in ({str}, {list}, {dict}):
        return parts[0] if parts else None
    if kinds == {str}:
        return "\n\n".join(parts)
    if kinds == {list}:
        return [x for p in parts for x in p]
    out: dict = {}
    for key, value in ((k, v) for p in parts for k, v in p.items()):
        held = out.get(key)
        if isinstance(held, list) and isinstance(value, list):
            out[key] = held + value
        elif held is None or held in ("", []):
            out[key] = value
    return out


_JSON_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}
_FORMATS = {"email": r"[^@\s]+@[^@\s]+\.[^@\s]+", "uri": r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s]+", "date": r"\d{4}-\d\d-\d\d", "date-time": r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:?\d\d)"}


def _coerced(value, kind: str):
    """The value as a JSON type where it can be told, by the rules of type coercion; (fits, value)."""
    if kind in ("number", "integer"):
        if isinstance(value, bool) or value is None:
            value = int(value or 0)
        if isinstance(value, str):
            try:
                value = float(value) if value.strip() else value
            except ValueError:
                return False, value
        fits = isinstance(value, int | float) and math.isfinite(value) and (kind == "number" or float(value).is_integer())
        return fits, value
    if kind == "string" and isinstance(value, bool | int | float):
        return True, str(value).lower() if isinstance(value, bool) else str(value)
    if kind == "string" and value is None:
        return True, ""
    if kind == "boolean" and value in ("true", "false", 0, 1, None) and not isinstance(value, bool):
        return True, value in ("true", 1)
    if kind == "null" and value in ("", 0, False):
        return True, None
    return isinstance(value, _JSON_TYPES.get(kind, object)), value


def validate(value, schema, at: str = "") -> list[str]:
    """All errors of a value against a JSON schema, each with its place; values are coerced as far as they can be."""
    if not isinstance(schema, dict):
        return []
    errors, where = [], at or "/"
    if kinds := schema.get("type"):
        kinds = kinds if isinstance(kinds, list) else [kinds]
        tried = [_coerced(value, k) for k in kinds]
        exact = [k for k, (ok, _) in zip(kinds, tried) if ok and isinstance(value, _JSON_TYPES.get(k, int | float)) and not (k in ("number", "integer") and isinstance(value, bool))]
        if not exact and not any(ok for ok, _ in tried):
            return [f"{where} must be {', '.join(kinds)}"]
        if not exact:
            value = next(v for ok, v in tried if ok)
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{where} must be equal to one of the allowed values")
    if isinstance(value, str):
        errors += [f"{where} must NOT have fewer than {schema['minLength']} characters"] if len(value) < schema.get("minLength", 0) else []
        errors += [f"{where} must NOT have more than {schema['maxLength']} characters"] if len(value) > schema.get("maxLength", len(value)) else []
        try:
            errors += [f'{where} must match pattern "{schema["pattern"]}"'] if "pattern" in schema and not re.search(schema["pattern"], value) else []
        except re.error:
            pass
        errors += [f'{where} must match format "{schema["format"]}"'] if schema.get("format") in _FORMATS and not re.fullmatch(_FORMATS[schema["format"]], value) else []
    if isinstance(value, int | float) and not isinstance(value, bool):
        errors += [f"{where} must be >= {schema['minimum']}"] if value < schema.get("minimum", value) else []
        errors += [f"{where} must be <= {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, list):
        errors += [f"{where} must NOT have fewer than {schema['minItems']} items"] if len(value) < schema.get("minItems", 0) else []
        errors += [f"{where} must NOT have more than {schema['maxItems']} items"] if len(value) > schema.get("maxItems", len(value)) else []
        for k, x in enumerate(value):
            errors += validate(x, schema.get("items"), f"{at}/{k}")
    if isinstance(value, dict):
        errors += [f"{where} must have required property '{k}'" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        errors += [f"{where} must NOT have additional properties" for k in value if schema.get("additionalProperties") is False and k not in known]
        for k, sub in known.items():
            if k in value:
                errors += validate(value[k], sub, f"{at}/{k}")
    return errors


def _plain(text: str) -> str:
    return " ".join(x for x in JS_WS_PY.split(re.sub(f"[^a-z0-9{JS_WS_CHARS}]", " ", text.lower())) if x)


def _scalar(x) -> bool:
    return isinstance(x, str | int | float) and not isinstance(x, bool)


def _grounded(value, source: str, digits: str) -> bool:
    """Whether a scalar stands in the plain source: a number by its digits, a text whole or by three in five of its longer words."""
    if not isinstance(value, str):
        shown = repr(int(value)) if isinstance(value, float) and value.is_integer() else repr(value)
        return re.sub(r"\D", "", shown) in digits
    plain = _plain(value)
    words = [w for w in plain.split(" ") if len(w) > 2]
    return len(plain) < 2 or plain in source or not words or sum(w in source for w in words) >= GROUNDED * len(words)


def confidence(data, source: str | None) -> dict:
    """fields (present, grounded, confidence), suspect, missing and the overall mean of what was extracted, against its source.

    An array stands for its first object; an array field for the share of its grounded scalars, an object for any of its own.
    """
    record = next((d for d in data if isinstance(d, dict)), None) if isinstance(data, list) else data if isinstance(data, dict) else None
    plain = _plain(source or "")
    digits = re.sub(r"\D", "", plain)
    fields = {}
    for key, value in (record or {}).items():
        share = 1.0
        if populated(value):
            leaves = [x for x in (value if isinstance(value, list) else value.values() if isinstance(value, dict) else [value]) if _scalar(x)]
            hits = sum(_grounded(x, plain, digits) for x in leaves)
            if isinstance(value, list):
                share = hits / len(leaves) if leaves else 1.0
            else:
                share = float(hits > 0 or not leaves and not isinstance(value, bool))
            if isinstance(value, bool):
                share = float(_grounded(str(value).lower(), plain, digits))
        fields[key] = {"present": populated(value), "grounded": populated(value) and share >= GROUNDED, "confidence": LOW + (HIGH - LOW) * share if populated(value) else 0.0}
    overall = sum(f["confidence"] for f in fields.values()) / len(fields) if fields else 0.0
    return {
        "overall": math.floor(overall * 1000 + 0.5) / 1000, "fields": fields,
        "suspect": [k for k, f in fields.items() if f["present"] and not f["grounded"]], "missing": [k for k, f in fields.items() if not f["present"]],
    }


def report(url: str, title: str | None, data: dict, warning: str | None = None) -> str:
    """Extracted data as markdown: a heading for each field, code, lists of objects, bullets, and objects as JSON."""
    cap = lambda k: k[:1].upper() + k[1:]
    show = lambda v: {True: "true", False: "false", None: "null"}.get(v, v) if isinstance(v, bool | type(None)) else v

    def item(n: int, x) -> str:
        if not isinstance(x, dict):
            return f"- {show(x)}\n"
        fields = "".join(f"**{cap(k)}**:\n" + ("".join(f"- {show(y)}\n" for y in v) if isinstance(v, list) else f"{show(v)}\n") + "\n" for k, v in x.items())
        return f"#### Item {n}\n\n{fields}"

    def body(key: str, v) -> str:
        if v is None:
            return "*No data available*\n\n"
        if isinstance(v, dict):
            return f"```json\n{json.dumps(v, indent=2, ensure_ascii=False)}\n```\n\n"
        if not isinstance(v, list):
            return f"{show(v)}\n\n"
        if any(w in key.lower() for w in ("code", "example")):
            return "".join(f"#### Example {n}\n\n```typescript\n{x}\n```\n\n" for n, x in enumerate(v, 1))
        objects = bool(v) and isinstance(v[0], dict)
        return "".join(item(n, x) for n, x in enumerate(v, 1)) + ("" if objects else "\n")

    head = f"# {title or 'Extracted Content'}\n\nURL: {url}\n\n" + (f"> ⚠️ **Note**: {warning}\n\n" if warning else "")
    fields = "".join(f"### {cap(k)}\n\n{body(k, v)}" for k, v in data.items()) or "*No data could be extracted.*\n\n"
    return f"{head}## Extracted Data\n\n{fields}"


def prompt(content: Column, title: Column, url: Column, schema: dict | None = None, instructions: str | None = None) -> Column:
    """What a model is asked about a page: the page, the schema, the instructions, and JSON wherever there is a schema."""
    said = f"\n\nAdditional instructions: {instructions}{' and format as JSON' if schema and 'json' not in instructions.lower() else ''}" if instructions else "\n\nAdditional instructions: Extract the information and format as JSON" if schema else ""
    shape = f"\n\nPlease extract information using this JSON schema:\n{json.dumps(schema, indent=2)}" if schema else ""
    named = F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(F.lit(' with title "'), title, F.lit('"')))
    return F.concat(F.lit("I need to extract information from the following web content from "), url, named, F.lit((" and return it as JSON" if schema else "") + ":\n\n"), F.coalesce(content, F.lit("")), F.lit(shape + said))


def resolve_template(template: str, values: dict) -> str:
    """An address template with its placeholders replaced by encoded values; an error if one is missing or empty."""
    def put(m: re.Match) -> str:
        v = values.get(m[1])
        if v is None or v == "":
            raise ValueError(f"missing required URL parameter: {m[1]}")
        return quote(str(v), safe="-_.!~*'()")

    return re.sub(r"\{(\w+)\}", put, template)


def resolved(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """(url, error) of a template over columns: null and the first missing name where a value is null or empty."""
    from gleanspark.functions.guards import encode_component

    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))
    out, error = F.lit(template), F.lit(None).cast("string")
    for n in reversed(names):
        v = values.get(n, F.lit(None)).cast("string")
        out = F.replace(out, F.lit("{" + n + "}"), encode_component(F.coalesce(v, F.lit(""))))
        error = F.when(F.coalesce(v, F.lit("")) == "", f"missing required URL parameter: {n}").otherwise(error)
    return F.when(error.isNull(), out), error


def extract_with(pages: DataFrame, complete: Callable[[str], str | None], schema: dict | None = None, instructions: str | None = None, key: str = "page_id", text: str = "content", url: str = "url", title: str = "title") -> DataFrame:
    """(key, data, chunks, errors, confidence): what a completer makes of each page, asked per chunk beyond a size, merged, validated, grounded.

    Data is JSON text and null where no chunk gave any. Null texts give null data.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(text).alias("c"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.col(url).alias("u"))
    ask = f"\n\n{json.dumps(schema)}" if schema else ""

    def one(c: str | None, t: str, u: str | None) -> tuple:
        pieces = [c] if c is None or tokens(c) <= CHUNK_BEYOND else chunk(c)
        answers = [complete(f"{u}\n{t}\n\n{p}{ask}\n\n{instructions or ''}") for p in pieces if p]
        values = [v for ok, v in map(parse_json, answers) if ok] if schema else [a for a in answers if a]
        data = merge(values) if values else None
        return None if data is None else json.dumps(data, ensure_ascii=False), len(answers), validate(data, schema) if data is not None else [], confidence(data, c)["overall"] if schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(c, t, u) for c, t, u in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "data", "chunks", "errors", "confidence"])

    return rows.mapInArrow(run, f"{key} {kind}, data string, chunks int, errors array<string>, confidence double")


def merged(parts: DataFrame, key: str = "item_id", order: str = "part_no", data: str = "data") -> DataFrame:
    """(key, data): partial results as JSON text, merged in order per key. Parts that are no JSON are texts; null parts are left out."""
    kind = parts.schema[key].dataType.simpleString()
    rows = parts.where(F.col(data).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d")))), lambda s: s["d"]).alias("ds"))

    def value(t: str):
        ok, v = parse_json(t)
        return v if ok else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [merge([value(t) for t in ds]) for ds in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m if isinstance(m, str) else json.dumps(m, ensure_ascii=False) for m in made], pa.string())], [key, data])

    return rows.mapInArrow(run, f"{key} {kind}, {data} string")


def graded(records: DataFrame, key: str, data: str, source: str) -> DataFrame:
    """(key, overall, suspect, missing) of extracted data as JSON text against the text it came from."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [confidence(parse_json(d)[1], s) for d, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m["overall"] for m in made], pa.float64()), pa.array([m["suspect"] for m in made], pa.list_(pa.string())), pa.array([m["missing"] for m in made], pa.list_(pa.string()))], [key, "overall", "suspect", "missing"])

    return records.select(F.col(key), F.col(data), F.col(source)).mapInArrow(run, f"{key} {kind}, overall double, suspect array<string>, missing array<string>")


def valid_name(name: Column) -> Column:
    """Whether a saved extraction may have this name."""
    return F.coalesce(name.rlike(r"^[a-z0-9_]{1,48}\z"), F.lit(False))


def spec_summary(specs: DataFrame) -> DataFrame:
    """What is shown of saved extractions: whether they are bound to a session, but not to which; in order of their names."""
    shown = [c for c in ("id", "name", "description", "url_template", "params", "health", "last_verified_at", "verify") if c in specs.columns]
    return specs.select(*shown, (F.coalesce(F.col("session_id"), F.lit("")) != "").alias("session_bound")).orderBy("name")
