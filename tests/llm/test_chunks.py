import math
import re

from gleanspark.functions.text import JS_WS_CHARS, JS_WS_PY
from gleanspark.llm.chunks import pieces, unit_starts

SCHEMA = "item_id bigint, text string, max_tokens int, overlap_rate double, _x string"


def words(t):
    return [w for w in JS_WS_PY.split(t) if w]


def brute(text, limit):
    """Lines at which units start, line by line."""
    limit = limit if limit and limit > 0 else 2048
    if text is None or math.ceil(len(words(text)) * 1.3) <= limit:
        return set()
    out, inside, fresh = set(), False, True
    for n, line in enumerate(text.split("\n"), 1):
        t = line.strip(JS_WS_CHARS)
        if inside:
            if t.startswith("```"):
                inside, fresh = False, True
        elif t.startswith("```"):
            out.add(n)
            inside = True
        elif not t:
            fresh = True
        else:
            if fresh or re.match(f"#{{1,6}}(?:[{JS_WS_CHARS}]|$)", t):
                out.add(n)
            fresh = False
    return out


TEXTS = ["", None, " \n\xa0", "a b c", "# h\nx\n## g\n\n\ny z\n```py\n\n# no\n```\ntail\r\n\r\n#\n####### seven\nend", "```\nnever closed\n\n# x", "﻿ a\n  # b\n   ```\nq\n ``` r\ns", "one " * 400 + "\n\n" + "two. " * 300, "|a|b|\n|-|-|\n|1|2|", "x" * 30000]


def test_units_and_pieces(spark):
    rows = [(k, t, m, r, "c") for k, (t, m, r) in enumerate((t, m, r) for t in TEXTS for m, r in ((1, 0.1), (3, None), (7, 0.5), (0, -1.0), (None, float("nan")), (20, 1.5)))]
    df = spark.createDataFrame(rows + rows[:7], SCHEMA)
    got = {}
    for r in unit_starts(df).collect():
        got.setdefault(r.item_id, set()).add(r.line_no)
    want = {k: brute(t, m) for k, t, m, _, _ in rows if brute(t, m)}
    assert got == want
    parts = {}
    for r in pieces(df).orderBy("item_id", "piece_no").collect():
        parts.setdefault(r.item_id, []).append(r)
    assert set(parts) == set(want)
    for k, t, m, _, _ in rows:
        if k in parts:
            m = m if m and m > 0 else 2048
            assert all(p.tokens <= max(m, 2) for p in parts[k])
            assert [w for p in parts[k] for w in words(p.text)[p.repeated :]] == words(t)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert unit_starts(df).count() == 0 and pieces(df).count() == 0
