"""Text columns with the white space, rounding and counting rules of JavaScript."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript (\s and trim), as a class for Java, Python and RE2.
JS_WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
JS_WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_WS_PY = re.compile(f"[{JS_WS_CHARS}]+")

#: Estimated tokens of a word, and the limit and overlap that hold where none is given (fixed values).
TOKENS_PER_WORD, DEFAULT_MAX_TOKENS, DEFAULT_OVERLAP_RATE = 1.3, 2048, 0.1


def js_trim(c: Column) -> Column:
    """Without white space at both ends, by JavaScript's rule; null stays null."""
    return F.regexp_replace(c, f"^{JS_WS}+|{JS_WS}+$", "")


def word_count(c: Column) -> Column:
    """Words parted by JavaScript white space; null and blank texts have 0."""
    return F.coalesce(F.size(F.filter(F.split(c, f"{JS_WS}+"), lambda w: w != "")), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """ceil(1.3 x words) in double arithmetic; null and blank texts have 0."""
    return F.ceil(word_count(c).cast("double") * F.lit(TOKENS_PER_WORD).cast("double")).cast("int")


def effective_limit(max_tokens: Column) -> Column:
    """The token limit that holds: null and non-positive limits mean the default."""
    return F.when(max_tokens > 0, max_tokens).otherwise(F.lit(DEFAULT_MAX_TOKENS)).cast("int")


def effective_overlap(rate: Column, limit: Column) -> Column:
    """Tokens to repeat: floor(limit x rate), at most limit - 1; null, NaN, infinite and negative rates mean the default."""
    ok = rate.isNotNull() & ~F.isnan(rate) & (rate >= 0) & (rate < F.lit(float("inf")))
    return F.least(F.floor(limit * F.when(ok, rate).otherwise(F.lit(DEFAULT_OVERLAP_RATE))), limit - 1).cast("int")


def normalise_for_grounding(c: Column) -> Column:
    """Lower case, all but a-z, 0-9 and white space as blanks, runs of blanks as one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"(?:(?!{JS_WS})[^a-z0-9])", " "), f"{JS_WS}+", " "))


def site_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without user, port and one leading www.; null where there is no host."""
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))
