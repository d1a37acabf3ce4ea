import datetime as dt
import random

from gleanspark.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, url string, options_fingerprint string, content string, scraped_at timestamp, delivered_at timestamp, _b int, url_k0 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def found(spark, rows, **kw):
    return {tuple(r)[:4] for r in snapshot_changes(frame(spark, rows), **kw).collect()}


def test_statuses_nulls_and_gaps(spark):
    rows = [
        (1, "a", "f", "x", day(1), day(1)), (1, "b", "f", None, day(1), day(1)), (1, "c", None, "", day(1), day(1)), (1, None, "f", "n", day(1), day(1)), (1, "gone", "f", "x", day(1), day(1)),
        (4, "a", "f", "old", day(2), day(9)), (4, "a", "f", "x", day(3), day(2)), (4, "b", "f", "", day(2), day(2)), (4, "c", None, "", day(2), day(2)), (4, None, "f", "m", day(2), day(2)), (4, "new", "f", "x", day(2), day(2)), (4, "new", "f", "x", day(2), day(2)),
        (None, "a", "f", "zzz", day(9), day(9)),
    ]
    assert found(spark, rows) == {(4, "b", "f", "changed"), (4, None, "f", "changed"), (4, "gone", "f", "removed"), (4, "new", "f", "new")}


def test_empty_and_first(spark):
    assert found(spark, []) == set()
    assert found(spark, [(3, "a", "f", "x", day(1), day(1))]) == set()


def test_line_diffs(spark):
    rows = [(1, "a", "f", "one\n two \nthree", day(1), day(1)), (2, "a", "f", "three\nfour\nfour\n\none", day(2), day(2))]
    r = snapshot_changes(frame(spark, rows), with_diff=True).collect()
    assert [(x.change_status, x.added, x.removed, x.previous_scrape_at) for x in r] == [("changed", ["four"], ["two"], day(1))]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(s, f"u{rng.randrange(60)}", rng.choice("fg"), rng.choice(["x", "y", None]), day(rng.randrange(40)), day(s)) for s in (2, 3, 7) for _ in range(120)]
    states = {}
    for s, u, f, c, t, d in rows:
        import hashlib

        rank = (t, d, hashlib.sha256(c.encode()).digest() if c is not None else b"")
        if (s, u, f) not in states or rank > states[s, u, f][0]:
            states[s, u, f] = (rank, c)
    want = set()
    for p, s in ((2, 3), (3, 7)):
        for u, f in {k[1:] for k in states}:
            a, b = states.get((s, u, f)), states.get((p, u, f))
            if a and not b:
                want.add((s, u, f, "new"))
            elif b and not a:
                want.add((s, u, f, "removed"))
            elif a and b and a[1] != b[1]:
                want.add((s, u, f, "changed"))
    assert found(spark, rows) == want
