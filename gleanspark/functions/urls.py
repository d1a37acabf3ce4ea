"""URL columns: parts, normal forms, predicates and scores, all as native expressions.

Addresses without a scheme and host are not parsed: predicates are false, normal forms return the input. Null stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_CRAWL = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "_ga", "mc_cid", "mc_eid", "ref", "source",
    "campaign", "medium", "term", "content", "affiliate_id",
]
TRACKING_DEDUP = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "campaign"]
MULTI_PART_TLDS = [
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "net.uk", "sch.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au",
    "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz", "co.za", "org.za", "web.za", "gov.za", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "com.br",
    "net.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "co.in", "net.in", "org.in", "gen.in", "firm.in", "com.sg", "com.hk", "com.mx",
    "com.tr", "com.ar", "com.tw", "com.pl", "com.ua",
]
FILE_ENDINGS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "7z", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp3", "mp4", "avi",
    "mov", "wmv", "flv", "exe", "dmg", "pkg", "deb", "rpm", "iso", "img",
]
NON_PAGE_ENDINGS = [
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "tiff", "css", "js", "mjs", "map", "json", "xml", "rss", "atom", "pdf", "zip", "gz", "tar",
    "rar", "7z", "dmg", "exe", "bin", "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm", "ogg", "wav", "woff", "woff2", "ttf", "eot", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx",
]
DEPTH_SCORES = (1.0, 0.5, 0.333, 0.25)
FRESHNESS_SCORES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)

_HEAD = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]*))?"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _HEAD, 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _HEAD, 2))


def port(u: Column) -> Column:
    """The port where it is not the scheme's own, else ''."""
    p = F.regexp_extract(u, _HEAD, 3)
    return F.when(((scheme(u) == "http") & (p == "80")) | ((scheme(u) == "https") & (p == "443")), "").otherwise(p)


def path(u: Column) -> Column:
    """The path, '/' where there is none; '' for what isn't an absolute URL."""
    p = F.regexp_extract(u, _HEAD + r"([^?#]*)", 4)
    return F.when(host(u) == "", "").when(p == "", "/").otherwise(p)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _build(u: Column, host_: Column, path_: Column, query_: Column, scheme_: Column | None = None) -> Column:
    p = port(u)
    return F.concat(scheme(u) if scheme_ is None else scheme_, F.lit("://"), host_, F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)), path_, F.when(query_ == "", "").otherwise(F.concat(F.lit("?"), query_)))


def _bare_path(u: Column) -> Column:
    p = path(u)
    return F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def _params(u: Column, drop: Sequence[str], ordered: bool) -> Column:
    """The query without some parameters, written as a form writes it, in order of the names if asked."""
    kept = F.filter(F.split(query(u), "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(list(drop)))
    kept = F.transform(kept, lambda x: F.replace(F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))), F.lit("%20"), F.lit("+")))
    if ordered:
        kept = F.transform(F.array_sort(F.transform(kept, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    return F.array_join(kept, "&")


def crawl_key(u: Column) -> Column:
    """Without tracking parameters, fragment and last slash, parameters in order, host in lower case."""
    return F.when(host(u) == "", u).otherwise(_build(u, host(u), _bare_path(u), _params(u, TRACKING_CRAWL, True)))


def dedup_key(u: Column) -> Column:
    """Without some tracking parameters, fragment and last slash; parameters as they come."""
    return F.when(host(u) == "", u).otherwise(_build(u, host(u), _bare_path(u), _params(u, TRACKING_DEDUP, False)))


def similar_urls(u: Column) -> Column:
    """Variants that may name the same page: with and without last slash, www, the other scheme and the index file."""
    n = crawl_key(u)
    h, p, q = host(n), path(n), query(n)
    slash = F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
    other = F.when(h.startswith("www."), F.regexp_replace(h, r"^www\.", "")).otherwise(F.concat(F.lit("www."), h))
    turned = F.when(scheme(n) == "https", "http").when(scheme(n) == "http", "https")
    return F.array_distinct(F.filter(F.array(
        n, _build(n, h, slash, q), _build(n, other, p, q), _build(n, other, slash, q), _build(n, h, p, q, turned),
        F.when(~p.contains("."), _build(n, h, F.concat(slash, F.lit("index.html")), q)), F.when(p.endswith("/index.html"), _build(n, h, F.regexp_replace(p, "/index\\.html", "/"), q)),
    ), lambda x: x.isNotNull()))


def are_similar(a: Column, b: Column) -> Column:
    return F.array_contains(similar_urls(a), crawl_key(b))


def domain(u: Column) -> Column:
    """Host without www., '' where there is none."""
    return F.regexp_replace(host(u), r"^www\.", "")


def ending(u: Column) -> Column:
    return F.lower(F.regexp_extract(path(u), r"\.([^./]*)$", 1))


def is_file(u: Column) -> Column:
    return ending(u).isin(FILE_ENDINGS)


def is_valid(u: Column) -> Column:
    """http or https, with a host of three letters or more."""
    return F.coalesce(scheme(u).isin("http", "https") & (F.length(host(u)) >= 3), F.lit(False))


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda x: x != "")


def depth(u: Column) -> Column:
    return F.size(segments(u))


def registrable(h: Column) -> Column:
    """The last two labels of a host, three where the last two are a suffix of several parts; addresses as they are."""
    bare = F.regexp_replace(F.lower(h), r"\.$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$") | bare.contains(":") | (n <= 2), bare).when(two.isin(MULTI_PART_TLDS), three).otherwise(two)


def same_site(u: Column, base: Column, subdomains: bool = True) -> Column:
    a, b = host(u), host(base)
    return (a != "") & (b != "") & ((registrable(a) == registrable(b)) if subdomains else (a == b))


def included(u: Column, patterns: Sequence[str]) -> Column:
    """Whether the path matches any pattern: as a regular expression where it looks like one, else as a part; any case."""
    p = path(u)
    out = F.lit(not patterns)
    for x in patterns:
        out = out | (p.rlike(f"(?i){x}") if any(s in x for s in ("^", "$", ".*", "\\")) else F.lower(p).contains(x.lower()))
    return out & (host(u) != "")


def excluded(u: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for x in patterns:
        out = out | F.lower(u).contains(x.lower())
    return out & (host(u) != "")


def relevance(u: Column, search: str | None) -> Column:
    """Share of the terms in path and query, half a point more for a whole segment, at most 1; 0.5 for what isn't a URL."""
    import re

    if not search:
        return F.lit(1.0)
    terms = re.split(r"\s+", search.lower())
    text = F.lower(F.concat(path(u), F.when(query(u) == "", "").otherwise(F.concat(F.lit("?"), query(u)))))
    parts = F.transform(F.split(path(u), "/"), F.lower)
    score = sum((F.when(text.contains(t), 1.0).otherwise(0.0) + F.when(F.array_contains(parts, t), 0.5).otherwise(0.0) for t in terms), F.lit(0.0))
    return F.when(host(u) == "", 0.5).otherwise(F.least(score / len(terms), F.lit(1.0)))


def keyword_score(u: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(1.0)
    return sum((F.when(F.lower(u).contains(w.lower()), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / len(words)


def depth_score(u: Column, best: int = 3) -> Column:
    s = segments(u)
    n = F.size(s) - F.when(F.lower(F.try_element_at(s, F.lit(-1))).isin("index.html", "index.php"), 1).otherwise(0)
    away = F.abs(n - best)
    out = F.lit(1.0) / (F.lit(1) + away)
    for k in range(len(DEPTH_SCORES) - 1, -1, -1):
        out = F.when(away == k, DEPTH_SCORES[k]).otherwise(out)
    return out


def freshness(u: Column, year: int) -> Column:
    """By the first year of four digits that stands alone in the path."""
    found = F.regexp_extract(path(u), r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    age = F.lit(year) - F.try_to_number(found, F.lit("9999")).cast("int")
    out = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.1) * age)
    for k in range(len(FRESHNESS_SCORES) - 1, -1, -1):
        out = F.when(age == k, FRESHNESS_SCORES[k]).otherwise(out)
    return F.when(found == "", 0.5).when(age < 0, 1.0).otherwise(out)


def composite_score(u: Column, words: Sequence[str] = (), year: int | None = None, best: int = 3, weights: tuple[float, float, float] = (1, 1, 1)) -> Column:
    """Weighted mean of the scores that apply; 0.5 where the weights add up to nothing."""
    parts = [(weights[1], depth_score(u, best))]
    if words:
        parts.insert(0, (weights[0], keyword_score(u, words)))
    if year is not None:
        parts.append((weights[2], freshness(u, year)))
    total = float(sum(w for w, _ in parts))
    return F.lit(0.5) if total <= 0 else F.least(F.greatest(sum((F.lit(float(w)) * s for w, s in parts), F.lit(0.0)) / total, F.lit(0.0)), F.lit(1.0))


def child_link(u: Column, seed: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), external: bool = False, subdomains: bool = False, whole: bool = False) -> Column:
    """Whether a link is followed: same host but for www., no file, not excluded, included. Patterns mind case."""
    import re

    def valid(x: str) -> bool:
        try:
            re.compile(x)
        except re.error:
            return False
        return True

    a, b = domain(u), domain(seed)
    near = F.lit(True) if external else ((a == b) | (a.endswith(F.concat(F.lit("."), b)) if subdomains else F.lit(False)))
    target = u if whole else path(u)
    out = (a != "") & near & ~ending(u).isin(NON_PAGE_ENDINGS)
    for x in filter(valid, exclude):
        out = out & ~target.rlike(x)
    keep = [target.rlike(x) for x in filter(valid, include)]
    if keep:
        any_ = keep[0]
        for k in keep[1:]:
            any_ = any_ | k
        out = out & any_
    return out


def resolve(href: Column, base: Column) -> Column:
    """A link as an absolute http address without fragment; null for others. Dot segments are kept."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(?:/(?:[^?#]*/)?)?)", 1)
    return (
        F.when(h.rlike(r"^(?i)https?://[^/?#]"), h)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), h))
        .when(h == "", F.regexp_replace(base, r"#.*$", ""))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), h))
    )
