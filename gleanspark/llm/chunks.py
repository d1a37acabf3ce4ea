"""Splitting oversized texts at natural boundaries with bounded regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.text import JS_WS, TOKENS_PER_WORD, effective_limit, effective_overlap, estimate_tokens

#: White space within a line.
H = JS_WS.replace("\\n", "")
FENCE = f"```(?s:.*?)(?:\\n{H}*+```[^\\n]*+|\\z)"
#: From a visible character up to a blank line, a heading, a fence or the end of the text. Only single characters are
#: repeated, so Java's matcher loops and doesn't recurse, however long the text.
BLOCK = f"[^\\n](?s:.*?)(?=\\n{H}*+(?:\\n|\\z|#{{1,6}}(?:{JS_WS}|\\z)|```)|\\z)"
#: White space before a unit, then the unit. The matches follow one another without a gap.
UNIT = f"{JS_WS}*+(?:{FENCE}|{BLOCK})"
#: A word with the white space behind it.
WORD = f"[^{JS_WS[1:-1]}]++{JS_WS}*+"
SENTENCE_END = "[.!?\\u2026\\u3002\\uFF01\\uFF1F\\u061F\\u0964][\"'\\u2019\\u201D\\u00BB)\\]]*$"


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _cases(items: DataFrame, item: str, text: str, max_tokens: str, rate: str) -> DataFrame:
    """The texts over their limit, each once."""
    rows = items.select(F.col(item).alias("_i"), F.col(text).alias("_x"), effective_limit(F.col(max_tokens)).alias("_limit"), F.col(rate).alias("_rate")).where("_x is not null")
    rows = rows.withColumn("_o", effective_overlap(F.col("_rate"), F.col("_limit"))).drop("_rate").where(estimate_tokens(F.col("_x")) > F.col("_limit"))
    return rows.distinct().withColumn("_h", F.xxhash64("_x", "_limit", "_o"))


def unit_starts(items: DataFrame, item: str = "item_id", text: str = "text", max_tokens: str = "max_tokens", rate: str = "overlap_rate") -> DataFrame:
    """(item, line_no): the lines at which a unit of a text over its limit starts.

    Null, empty and blank texts are within any limit and give no rows. Repeated rows count once; rows of one item with
    different texts give the lines of each.
    """
    units = _cases(items, item, text, max_tokens, rate).select("_i", "_h", F.posexplode(F.regexp_extract_all("_x", F.lit(UNIT), F.lit(0))).alias("_n", "_u"))
    gap = F.regexp_extract("_u", f"^{JS_WS}*+", 0)
    lines = units.select("_i", "_h", "_n", _newlines(F.col("_u")).alias("all"), _newlines(gap).alias("gap"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("_i", "_h").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select(F.col("_i").alias(item), (before + F.col("gap") + 1).cast("int").alias("line_no")).distinct()


def pieces(items: DataFrame, item: str = "item_id", text: str = "text", max_tokens: str = "max_tokens", rate: str = "overlap_rate") -> DataFrame:
    """(item, piece_no, text, tokens, repeated): the ordered pieces of each text over its limit.

    Every word becomes one letter for the strongest boundary behind it: u end of a unit, s end of a sentence, l end of a
    line, w none. Over these letters a bounded quantifier takes as many words as the limit allows up to the strongest
    boundary there is, and any word where there is none. From the second piece on, `repeated` words of the text before
    precede it. A piece is at most the limit, which a single word exceeds only where the limit is below 2.
    Nulls, blanks and repeated rows as in unit_starts.
    """
    cases = _cases(items, item, text, max_tokens, rate)
    w = F.greatest(F.lit(1), F.floor(F.col("_limit") / F.lit(TOKENS_PER_WORD)).cast("int"))
    o = F.least(F.floor(F.col("_o") / F.lit(TOKENS_PER_WORD)).cast("int"), w - 1)
    words = F.regexp_extract_all(F.regexp_replace("_x", f"^{JS_WS}+", ""), F.lit(WORD), F.lit(0))
    units = F.regexp_extract_all("_x", F.lit(UNIT), F.lit(0))

    def letter(word: Column) -> Column:
        ends = F.regexp_replace(word, f"{JS_WS}+$", "").rlike(SENTENCE_END)
        return F.when(ends, "s").when(word.contains("\n"), "l").otherwise("w")

    # The last letter of a unit gives way to u.
    letters = F.transform(units, lambda u: F.regexp_replace(F.array_join(F.transform(F.regexp_extract_all(u, F.lit(WORD), F.lit(0)), letter), ""), ".$", "u"))
    fresh = (F.col("_w") - F.col("_r")).cast("string")
    less = (F.col("_w") - F.col("_r") - 1).cast("string")
    rule = F.concat(F.lit("[wlsu]{0,"), less, F.lit("}u|[wlsu]{0,"), less, F.lit("}s|[wlsu]{0,"), less, F.lit("}l|[wlsu]{1,"), fresh, F.lit("}"))
    cut = cases.select("_i", "_h", w.alias("_w"), o.alias("_r"), words.alias("_words"), F.array_join(letters, "").alias("_code")).select("_i", "_h", "_r", "_words", F.regexp_extract_all("_code", rule, F.lit(0)).alias("_p"))
    runs = cut.select("_i", "_h", "_r", F.posexplode("_p").alias("_n", "_c")).select("_i", "_h", "_r", "_n", F.length("_c").alias("_len"))
    upto = F.coalesce(F.sum("_len").over(Window.partitionBy("_i", "_h").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    spans = runs.withColumn("_from", upto).groupBy("_i", "_h").agg(F.array_sort(F.collect_list(F.struct("_n", "_from", "_len", F.least("_r", "_from").alias("_back")))).alias("_spans"))
    spans = spans.select(F.col("_i").alias("_si"), F.col("_h").alias("_sh"), "_spans")
    both = cut.join(spans, [F.col("_i").eqNullSafe(F.col("_si")), F.col("_h") == F.col("_sh")]).select("_i", "_words", F.explode("_spans").alias("s"))
    body = F.array_join(F.slice("_words", F.col("s._from") - F.col("s._back") + 1, F.col("s._len") + F.col("s._back")), "")
    out = both.select(F.col("_i").alias(item), (F.col("s._n") + 1).alias("piece_no"), F.regexp_replace(body, f"{JS_WS}+$", "").alias("text"), F.col("s._back").alias("repeated"))
    return out.select(item, "piece_no", "text", estimate_tokens(F.col("text")).alias("tokens"), "repeated")
