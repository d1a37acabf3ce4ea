import collections
import itertools
import random

from gleanspark.llm import packing


def test_rounds_of_several_blocks_share_no_container(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "x" * rng.randrange(1, 700)) for k in range(600)], "doc_id bigint, text string")
    caps = spark.createDataFrame([("s", 1000), ("m", 4096)], "container string, capacity int")
    room, seen = collections.Counter(), collections.Counter()
    for r in packing.pack(docs, caps).collect():
        room[r.capacity, r.container_no] += r.size
        seen[r.capacity, r.doc_id] += 1
    assert len(seen) == 1200 and set(seen.values()) == {1}
    assert all(v <= cap for (cap, _), v in room.items())


def test_every_undominated_filling_comes():
    """Whatever fits is yielded, or a larger free item may stand for one or two of its items."""
    rng = random.Random(6)
    most = 0
    for _ in range(120):
        sizes = sorted((rng.randrange(0, 60) for _ in range(rng.randrange(0, 11))), reverse=True)
        room = rng.randrange(0, 120)
        got = {tuple(sorted(sizes[x] for x in way)) for way in packing.fillings(sizes, room)}
        most = max(most, len(got))
        for k in range(len(sizes) + 1):
            for way in itertools.combinations(range(len(sizes)), k):
                left = room - sum(sizes[x] for x in way)
                free = [s for x, s in enumerate(sizes) if x not in way]
                if left < 0 or any(s <= left for s in free) or tuple(sorted(sizes[x] for x in way)) in got:
                    continue
                alone = any(sizes[x] < s <= sizes[x] + left for x in way for s in free)
                assert alone or any(sizes[x] + sizes[y] <= s <= sizes[x] + sizes[y] + left for x, y in itertools.combinations(way, 2) for s in free)
    wide = list(range(140, 100, -1))
    assert len({tuple(sorted(wide[x] for x in way)) for way in packing.fillings(wide, 240)}) > 12


def test_the_best_packing_is_found():
    rng = random.Random(7)

    def least(sizes, capacity):
        rooms, best = [], len(sizes)

        def go(k):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(sizes):
                best = len(rooms)
                return
            for b in range(len(rooms)):
                if rooms[b] >= sizes[k]:
                    rooms[b] -= sizes[k]
                    go(k + 1)
                    rooms[b] += sizes[k]
            rooms.append(capacity - sizes[k])
            go(k + 1)
            rooms.pop()

        go(0)
        return best

    for _ in range(60):
        sizes = sorted((rng.randrange(5, 60) for _ in range(rng.randrange(1, 10))), reverse=True)
        assert len(packing.complete(sizes, 100)) == least(sizes, 100)
    # Many items: 160 triples that fill containers of 1000, all cut apart.
    sizes = []
    for _ in range(160):
        a, b = rng.randrange(260, 480), rng.randrange(260, 480)
        sizes += [a, b, 1000 - a - b]
    sizes.sort(reverse=True)
    bins = packing.complete(sizes, 1000)
    assert sorted(x for b in bins for x in b) == list(range(480)) and len(bins) <= len(packing.best_fit(sizes, 1000))
