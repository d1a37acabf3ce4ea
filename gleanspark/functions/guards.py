"""Which addresses may be asked for or kept: filters of crawls and browsers, blocked hosts and resources, and older scores.

All are native columns. Null addresses give null, what isn't an absolute address false, unless it says otherwise.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions import urls as U

# Fixed values.
LEGACY_FILE_ENDINGS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "avi", "mov", "exe", "apk", "dmg", "iso"]
GOOD_WORDS, BAD_WORDS = ["about", "docs", "documentation", "guide", "tutorial", "help"], ["login", "signup", "register", "cart", "checkout"]
SIGN_IN_PATHS, SIGN_IN_QUERIES = ["/signin", "/login", "/signup", "/register"], ["signin", "continue="]
AD_HOSTS = [
    "googlesyndication.com", "adservice.google.com", "doubleclick.net", "googleadservices.com", "google-analytics.com", "googletagmanager.com", "googletagservices.com",
    "amazon-adsystem.com", "facebook.com/tr", "facebook.net", "advertising.com", "adtechus.com", "quantserve.com", "scorecard.com", "zedo.com", "adblade.com", "adform.net",
    "adnxs.com", "criteo.com", "outbrain.com", "taboola.com",
]
TRACKING_WORDS = ["tracking", "analytics", "telemetry", "metrics", "stats", "pixel", "gtm", "ga", "facebook", "twitter", "linkedin"]
HEAVY_KINDS = ["image", "font", "stylesheet", "media"]
PRIVATE_NAMES = r"^(localhost$|127\.|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
#: Ranges that are not routed publicly, by the registry of special purposes: first address, and bits of the prefix.
SPECIAL = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def any_of(tests: Sequence[Column], none: bool = False) -> Column:
    out = F.lit(none)
    for k, t in enumerate(tests):
        out = t if not k else out | t
    return out


def _patterns(patterns: Sequence[str]) -> list[str]:
    return [p for p in patterns if p]


def is_legacy_file(u: Column) -> Column:
    """Whether the path ends like a file, by the list of the older crawler."""
    return F.lower(U.path(u)).rlike(r"\.(" + "|".join(LEGACY_FILE_ENDINGS) + ")$")


def is_safe_name(u: Column) -> Column:
    """http or https, and no name or address of a private network."""
    return F.coalesce(U.scheme(u).isin("http", "https") & (U.host(u) != "") & ~U.host(u).rlike(PRIVATE_NAMES), F.lit(False))


def crawlable(u: Column, seed: str, depth: int, include: Sequence[str] = (), exclude: Sequence[str] = (), backward: bool = False, whole: bool = False) -> Column:
    """The older crawler's filter: depth, patterns (which mind case), below the seed's path unless backward, no file."""
    from urllib.parse import urlsplit

    key = U.crawl_key(u)
    on = key if whole else U.path(u)
    out = (U.host(u) != "") & (U.depth(key) <= depth) & ~is_legacy_file(key)
    if wanted := _patterns(include):
        out = out & any_of([on.rlike(p) for p in wanted])
    if unwanted := _patterns(exclude):
        out = out & ~any_of([on.rlike(p) for p in unwanted])
    return out if backward else out & U.path(key).startswith(urlsplit(seed).path or "/")


def origin(u: Column) -> Column:
    """Scheme, host and port where it isn't the scheme's own; '' for what isn't absolute."""
    return F.when(U.host(u) == "", "").otherwise(F.concat(U.scheme(u), F.lit("://"), U.host(u), F.when(U.port(u) == "", "").otherwise(F.concat(F.lit(":"), U.port(u)))))


def discoverable(u: Column, base: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), domains: Sequence[str] = ()) -> Column:
    """The browser's filter: the same origin, no host that holds an excluded domain, path patterns."""
    out = (origin(u) != "") & (origin(u) == origin(base))
    for d in domains:
        out = out & ~U.host(u).contains(d.lower())
    if include:
        out = out & any_of([U.path(u).rlike(p) for p in include])
    return out & ~any_of([U.path(u).rlike(p) for p in exclude])


def worth_visiting(u: Column) -> Column:
    """No page to sign in or up, and no other language asked for by a parameter."""
    p, q = F.lower(U.path(u)), F.lower(F.when(U.query(u) == "", "").otherwise(F.concat(F.lit("?"), U.query(u))))
    signs = any_of([p.contains(x) for x in SIGN_IN_PATHS] + [q.contains(x) for x in SIGN_IN_QUERIES])
    return (U.host(u) != "") & ~signs & ~(q.contains("hl=") & ~q.contains("hl=en"))


def legacy_score(u: Column) -> Column:
    """10 less for each segment, 1 for each character of the query, 20 more for one good word and 30 less for one bad; -100 for no address."""
    p = F.lower(U.path(u))
    score = -10 * U.depth(u) - F.length(U.query(u)) + F.when(any_of([p.contains(w) for w in GOOD_WORDS]), 20).otherwise(0) - F.when(any_of([p.contains(w) for w in BAD_WORDS]), 30).otherwise(0)
    return F.when(U.host(u) == "", -100).otherwise(score)


def is_ad(u: Column) -> Column:
    return any_of([u.contains(x) for x in AD_HOSTS])


def is_tracker(u: Column) -> Column:
    return any_of([F.lower(u).contains(x) for x in TRACKING_WORDS])


def blocked_resource(u: Column, kind: Column, ads: bool = True, heavy: bool = True) -> Column:
    """Requests of a page that aren't made: to hosts of ads, and for images, fonts, styles and media."""
    out = F.lit(False)
    if ads:
        out = out | is_ad(u)
    return out | kind.isin(HEAVY_KINDS) if heavy else out


def _number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))


def is_public_address(host: Column) -> Column:
    """Whether a literal IPv4 address is routed publicly; false for names and for literals in brackets that aren't global."""
    n = _number(host)
    special = any_of([n.between(int(net.network_address), int(net.broadcast_address)) for net in map(ipaddress.ip_network, SPECIAL)])
    return host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") & ~special


def blocked_request(u: Column) -> Column:
    """Whether a request goes to a literal address that isn't public. Names aren't resolved, other schemes are left alone.

    Literals of IPv6 are public only in 2000::/3 outside documentation and the tunnels 6to4 and Teredo.
    """
    six = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?\[([^\]]*)\]", 1))
    open6 = six.rlike(r"^[23][0-9a-f]{3}:") & ~six.rlike(r"^(2001:0?db8:|2001:0{0,4}:|2002:)")
    literal = U.host(u).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return scheme.isin("http", "https") & (((six != "") & ~open6) | ((six == "") & literal & ~is_public_address(U.host(u))))


def allowed_by(u: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """robots rules as a column: the longest pattern that matches the path and query holds, allow wins ties, none allows."""
    on = F.concat(U.path(u), F.when(U.query(u) == "", "").otherwise(F.concat(F.lit("?"), U.query(u))))
    out = F.lit(True)
    for ok, p in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        body = ".*".join(re.sub(r"([\\.^$|?+()\[\]{}])", r"\\\1", x) for x in p.removesuffix("$").split("*"))
        out = F.when(on.rlike("^" + body + ("$" if p.endswith("$") else "")), ok).otherwise(out)
    return (U.host(u) != "") & out


def cache_token(u: Column) -> Column:
    """Scheme, lower-case host and path without last slashes, percent-encoded as a component."""
    bare = F.when(U.host(u) == "", u).otherwise(F.concat(U.scheme(u), F.lit("://"), U.host(u), F.regexp_replace(U.path(u), "/+$", "")))
    return encode_component(bare)


def encode_component(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and -_.!~*'()."""
    out = F.url_encode(c)
    for have, want in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def cache_key(u: Column, prefix: str, options: dict) -> Column:
    """A key of discovery: the token, by which all variants of one address are found, and a hash of the options, lists in order."""
    import json

    rest = {k: sorted(v) if isinstance(v, list | tuple) else v for k, v in options.items() if v is not None}
    return F.concat(F.lit(prefix + ":"), cache_token(u), F.lit(":"), F.sha2(F.concat(F.to_json(F.struct(u.alias("url"))), F.lit(json.dumps(rest))), 256))

