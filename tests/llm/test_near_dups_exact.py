import random
import re

import pytest

from gleanspark.llm import near_dups
from gleanspark.llm.near_dups import group_pairs, near_duplicates

SCHEMA = "scrape_id bigint, content string, node bigint, sig string"


def shingles(text, words):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def linked(rows, words, threshold):
    sets = {i: s for i, t in rows if (s := shingles(t, words))}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def run(spark, rows, **kw):
    return near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA), **kw)


def fresh(rng, n):
    return [f"w{rng.getrandbits(48)}" for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 5])
def test_links_of_long_postings(spark, monkeypatch, block):
    """Each two of 30 texts are linked, all by the same tokens: each text has 29 links."""
    monkeypatch.setattr(near_dups, "BLOCK", block, raising=False)
    rng = random.Random(7)
    shared = fresh(rng, 160)
    rows = [(k, " ".join(shared + fresh(rng, 50))) for k in range(30)]
    assert len(linked(rows, 3, 0.6)) == 435
    assert {r.links for r in run(spark, rows, words=3, threshold=0.6).collect()} == {29}


def test_template_of_a_hot_site(spark):
    """Pages share 200 of 270 shingles, which links none; 40 pairs share three more, which does."""
    rng = random.Random(8)
    template, rows = fresh(rng, 202), []
    for k in range(40):
        three = fresh(rng, 3)
        rows += [(2 * k + x, " ".join(template + three + fresh(rng, 67))) for x in (0, 1)]
    rng.shuffle(rows)
    assert linked(rows, 3, 0.6) == {(2 * k, 2 * k + 1) for k in range(40)}
    got = {tuple(r) for r in group_pairs(run(spark, rows, words=3, threshold=0.6)).collect()}
    assert got == linked(rows, 3, 0.6)


def test_short_and_repetitive_texts(spark):
    """Texts of one to seven distinct shingles, and long ones of few; each pair's sets are compared."""
    rng = random.Random(9)
    rows = []
    for k in range(60):
        w = fresh(rng, rng.randrange(5, 12))
        rows += [(4 * k, " ".join(w)), (4 * k + 1, " ".join(w[1:] if k % 2 else w + fresh(rng, 1)))]
        rows += [(4 * k + 2, " ".join(w[:3] * 40)), (4 * k + 3, " ".join((w[:3] * 40)[:-1] + fresh(rng, 1)))]
    rows += [(900, "a b c d e f g h i j k"), (901, "a b c d e f g h i j x"), (902, "a b c d e f g h i j")]
    want = linked(rows, 5, 0.8)
    assert (900, 902) in want and len(want) > 20
    found = run(spark, rows).collect()
    groups = {r.scrape_id: r.group_id for r in found}
    assert all(groups[a] == groups[b] for a, b in want)
    up = {}

    def top(x):
        return x if up.get(x, x) == x else top(up[x])

    for a, b in want:
        up[top(b)] = top(a)
    ids = sorted(groups)
    assert all((groups[a] == groups[b]) == (top(a) == top(b)) for a in ids for b in ids)


@pytest.mark.parametrize("threshold, rare", [(0.6, 0), (0.6, 3), (0.8, 1), (0.35, 2)])
def test_signatures_of_frequent_tokens(monkeypatch, threshold, rare):
    """Each pair of sets at the threshold has a signature in common, with all, some or few tokens frequent; sizes from 1 to 700."""
    import numpy as np

    from gleanspark.llm.shingles import mix

    monkeypatch.setattr(near_dups, "RARE", rare)
    rng = random.Random(int(threshold * 100) + rare)
    common, sets = [rng.getrandbits(46) for _ in range(900)], []
    for size in [*range(1, 30), 60, 83, 84, 120, 200, 335, 336, 337, 500, 700]:
        base = rng.sample(common, size)
        sets.append(base)
        for keep in (threshold, threshold + 0.03, 0.9):
            k = max(1, int(np.ceil(keep * size)))
            sets += [base[:k], base[:k] + rng.sample(common, min(3, size)), base[size - k :] + [rng.getrandbits(46)]]
    sets = [np.array(sorted(set(x)), dtype=np.uint64) for x in {frozenset(x) for x in sets}]
    n = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    _, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    df = counts[which].astype(np.int64)
    rarity = df.astype(np.float32).view(np.uint32) >> 16
    order = np.lexsort((mix(tokens), rarity, owner))
    o, sig, left, _ = near_dups._entries(owner, tokens[order], df[order], rarity[order], n, threshold)
    shown = {}
    for text, x, most in zip(o.tolist(), sig.tolist(), left.tolist()):
        shown.setdefault(text, {})[x] = max(most, shown.get(text, {}).get(x, 0))
    held, pairs = [set(x.tolist()) for x in sets], 0
    for a in range(len(sets)):
        for b in range(a):
            shared = len(held[a] & held[b])
            if shared and shared >= threshold * len(held[a] | held[b]) - 1e-9:
                pairs += 1
                assert any(min(shown[a][x], shown[b][x]) >= shared for x in shown[a].keys() & shown[b].keys())
    assert pairs > 100


@pytest.mark.parametrize("rare", [0, 4])
def test_links_by_combinations(spark, monkeypatch, rare):
    """The hot site and the long postings, with nearly all tokens taken for frequent."""
    monkeypatch.setattr(near_dups, "RARE", rare)
    rng = random.Random(11)
    shared = fresh(rng, 160)
    rows = [(k, " ".join(shared + fresh(rng, 50))) for k in range(20)]
    template = fresh(rng, 202)
    for k in range(15):
        three = fresh(rng, 3)
        rows += [(100 + 2 * k + x, " ".join(template + three + fresh(rng, 67))) for x in (0, 1)]
    want = linked(rows, 3, 0.6)
    got = {r.scrape_id: r.links for r in run(spark, rows, words=3, threshold=0.6).collect()}
    assert got == {k: sum(k in p for p in want) for k, _ in rows}
