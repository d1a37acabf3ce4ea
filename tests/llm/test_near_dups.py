import random
import re

from gleanspark.llm.shingles import set_keys, shingle_sets
from gleanspark.llm.near_dups import group_pairs, near_duplicates

SCHEMA = "scrape_id bigint, content string, node bigint, sig string"
WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]


def brute(rows, words, threshold, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if t is not None and len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                up[top(b)] = top(a)
    return {(a, b) for a in sets for b in sets if a < b and top(a) == top(b)}, set(sets)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def corpus(rng, groups=12, hot=40):
    rows, i = [], 0
    for g in range(groups):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60, 160)))
        for _ in range(hot if g == 0 else rng.randrange(1, 5)):
            i += 1
            rows.append((i, edited(rng, base, rng.randrange(0, 6))))
    return rows


def run(spark, rows, **kw):
    g = near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA), **kw).cache()
    return {tuple(r) for r in group_pairs(g).collect()}, g


def test_against_brute_force(spark):
    """One group is a third of all rows; words are few, so many tokens are frequent."""
    rng = random.Random(3)
    rows = corpus(rng)
    rows += [(900, rows[0][1]), (900, rows[0][1]), (901, None), (902, ""), (903, "too short"), (904, "word " * 3000)]
    want, members = brute([r for r in rows], 3, 0.6, 20)
    got, g = run(spark, rows, words=3, threshold=0.6, min_words=20)
    assert got == want
    ids = [r.scrape_id for r in g.collect()]
    assert sorted(ids) == sorted(members)


def test_defaults_and_empty(spark):
    rng = random.Random(4)
    rows = corpus(rng, 5, 6)
    assert run(spark, rows)[0] == brute(rows, 5, 0.8, 0)[0]
    assert run(spark, [])[0] == set()


def test_shingles():
    texts = ["A b c d", None, "", "x\0y z w", "É1 ß2 ß2 É1", "a b"]
    which, bounds, tokens = shingle_sets(texts, 3, 0)
    assert which.tolist() == [0, 3, 4] and (bounds[1:] - bounds[:-1]).tolist() == [2, 2, 2]
    a = set_keys(*shingle_sets(["one two three four"], 3, 0)[1:])
    b = set_keys(*shingle_sets(["ONE, two; three (four)"], 3, 0)[1:])
    assert a.tolist() == b.tolist()
