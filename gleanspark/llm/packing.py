"""Filling containers of fixed capacity with documents, by bin completion."""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import checkpointed

#: Documents are packed in blocks of about so many; a block's search visits at most so many nodes.
BLOCK, NODES, STEPS = 2000, 4000, 50
#: Containers emptier than this after the first round are emptied, and their content is packed again.
SLACK = 0.02


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: positions into sizes, which falls; each goes where the least room is left."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for k, s in enumerate(sizes):
        at = bisect.bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        bisect.insort(rooms, (room - s, b))
    return bins


def fillings(sizes: list[int], room: int, steps: list[int] | None = None, limit: float = math.inf) -> Iterator[list[int]]:
    """All undominated sets of positions that fill room, one at a time, those of large items first. sizes falls.

    A set is passed over if another item, free, may take the place of one or two of its items: it is larger, or as large
    as two, and fits. Of items of one size the first are taken. steps[0] counts the steps, and nothing more comes when it is at limit.
    """
    n = len(sizes)
    steps = [0] if steps is None else steps
    rising = sizes[::-1]
    tail = list(itertools.accumulate(rising, initial=0))[::-1]  # all from a position on
    # Position, room left, what is chosen, and the least size passed over, which must not fit in the end.
    stack: list[tuple[int, int, tuple[int, ...], int]] = [(0, room, (), room + 1)]
    while stack and steps[0] < limit:
        at, left, chosen, least = stack.pop()
        steps[0] += 1
        at = max(at, n - bisect.bisect_right(rising, left))
        if left - tail[at] >= least:
            continue
        if at >= n:
            if not _dominated(sizes, rising, chosen, left):
                yield list(chosen)
            continue
        s = sizes[at]
        stack.append((n - bisect.bisect_left(rising, s), left, chosen, min(least, s)))
        stack.append((at + 1, left - s, (*chosen, at), least))


def _fullest_first(sizes: list[int], ways: Iterator[list[int]]) -> Iterator[list[int]]:
    """All ways, in batches of which each begins with the least waste."""
    while batch := list(itertools.islice(ways, 16)):
        yield from sorted(batch, key=lambda way: -sum(sizes[x] for x in way))


def _dominated(sizes: list[int], rising: list[int], chosen: tuple[int, ...], left: int) -> bool:
    """Whether a free item fits in place of a smaller one of the set, or of two that are no larger together."""
    mine = Counter(sizes[x] for x in chosen)

    def free(least: int, most: int) -> bool:
        at = bisect.bisect_left(rising, least)
        while at < len(rising) and rising[at] <= most:
            end = bisect.bisect_right(rising, rising[at])
            if end - at > mine[rising[at]]:
                return True
            at = end
        return False

    own = sorted(x for x in mine if x)
    if left and any(free(x + 1, x + left) for x in own):
        return True
    pairs = {x + y for k, x in enumerate(own) for y in own[k:] if x != y or mine[x] > 1}
    return any(free(x, x + left) for x in pairs if x <= rising[-1])


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bin completion: the largest item's container is filled in every undominated way, depth first.

    Branches whose waste leaves no better packing than the incumbent are cut; the first incumbent is best fit. It is the
    optimum if it meets the bound or the search ends before `nodes` nodes, and otherwise the best that they show, or that STEPS
    times as many steps of looking for fillings show.
    """
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    steps, spent = [0], 0
    # Containers so far, what is free, the waste, and the ways to fill the next container.
    stack = [([], list(range(len(sizes))), 0, None)]
    while stack and len(best) > bound and spent < nodes and steps[0] < nodes * STEPS:
        bins, free, waste, ways = stack.pop()
        if waste > (len(best) - 1) * capacity - total:
            continue
        if not free:
            if len(bins) < len(best):
                best = bins
            continue
        head, rest = free[0], free[1:]
        if ways is None:
            own = [sizes[x] for x in rest]
            ways = _fullest_first(own, fillings(own, capacity - sizes[head], steps, nodes * STEPS))
        option = next(ways, None)
        if option is None:
            continue
        spent += 1
        stack.append((bins, free, waste, ways))
        picked = {rest[x] for x in option}
        used = sizes[head] + sum(sizes[x] for x in picked)
        stack.append(([*bins, [head, *picked]], [x for x in rest if x not in picked], waste + capacity - used, None))
    return best


def _solve(items: DataFrame, count: int, round_no: int) -> DataFrame:
    """(capacity, doc, piece, size, bin, filled): items packed block by block."""
    kind = items.schema["doc"].dataType.simpleString()
    blocks = max(1, -(-count // BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy()
        capacity = int(table.column("capacity")[0].as_py())
        order = np.lexsort((table.column("key").to_numpy(), -size))
        bins = complete(size[order].tolist(), capacity)
        number, filled = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        block = int(table.column("block")[0].as_py())
        for k, b in enumerate(bins):
            at = order[b]
            number[at] = (2 * block + round_no) * (1 << 24) + k  # rounds differ in block numbers, so each has its own range
            filled[at] = size[at].sum()
        return pa.table({"capacity": table.column("capacity"), "doc": table.column("doc"), "piece": table.column("piece"), "size": table.column("size"), "bin": number, "filled": filled})

    keyed = items.withColumn("key", F.xxhash64("doc", "piece")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(blocks)))
    return keyed.groupBy("capacity", "block").applyInArrow(pack, f"capacity int, doc {kind}, piece int, size bigint, bin bigint, filled bigint")


def pack(docs: DataFrame, containers: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(capacity, doc, piece_no, pieces, start_byte, size, container_no): every document in one container per capacity.

    The size is that of the text in UTF-8 bytes. A document larger than the capacity, and no other, is cut into pieces
    of the capacity and a rest. Blocks of about BLOCK items are packed apart; what lies in their emptier containers
    is packed once more. Only ids and sizes are shuffled. Null and empty texts have size 0 and fit anywhere; repeated
    rows count once; null and non-positive capacities are passed over.
    """
    sizes = docs.select(F.col(doc).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("whole")).distinct()
    caps = [r[0] for r in containers.select("capacity").where("capacity > 0").distinct().orderBy("capacity").collect()]  # a table of a few sizes
    if not caps:
        caps = [0]
    each = sizes.select("doc", "whole", F.explode(F.array(*[F.lit(c).cast("int") for c in caps])).alias("capacity")).where("capacity > 0")
    cut = each.select("capacity", "doc", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("whole") / F.col("capacity")).cast("int") - 1))).alias("piece"))
    items = cut.select("capacity", "doc", "piece", F.least(F.col("capacity").cast("bigint"), F.col("whole") - F.col("piece") * F.col("capacity").cast("bigint")).alias("size"))
    n = sizes.count()
    first = checkpointed(_solve(items, n, 0))
    good = F.col("filled") >= F.col("capacity") * (1 - SLACK)
    loose = first.where(~good).select("capacity", "doc", "piece", "size")
    second = checkpointed(_solve(loose, max(1, loose.count() // max(1, len(caps))), 1))
    done = first.where(good).unionByName(second)
    out = done.select("capacity", F.col("doc").alias(doc), (F.col("piece") + 1).alias("piece_no"), (F.col("piece") * F.col("capacity").cast("bigint")).alias("start_byte"), "size", F.col("bin").alias("container_no"))
    whole = done.where("piece > 0").groupBy(F.col("capacity").alias("_c"), F.col("doc").alias("_d")).agg((F.max("piece") + 1).alias("pieces"))
    return out.join(whole, (F.col("capacity") == F.col("_c")) & F.col(doc).eqNullSafe(F.col("_d")), "left").select("capacity", doc, "piece_no", F.coalesce("pieces", F.lit(1)).alias("pieces"), "start_byte", "size", "container_no")
