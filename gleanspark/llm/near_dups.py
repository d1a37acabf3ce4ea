"""Groups of near-duplicate texts, found exactly by prefixes: rare tokens alone, frequent ones in combinations of two."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanspark.llm.shingles import mix, set_keys, shingle_sets
from gleanspark.llm.components import components
from gleanspark.session import checkpointed, release

#: The count sketch has 2^COUNT_BITS cells whatever the corpus, and is sent to all tasks.
COUNT_BITS, BLOCKS = 20, 64
#: Partial sketches of so many successive tasks are added up first, so that no task gets those of all.
NEAR = 64
#: Tokens of up to so many texts are indexed alone, more frequent ones in combinations of two.
RARE = 1024
#: Prefix tokens are dealt to parts of about so many; a part is held by one task.
PART = 1 << 22
#: Postings beyond so many texts are paired block by block, each pair of blocks in a part of its own choice.
BLOCK = 1 << 15
#: A text's tokens counted by CELLS hash cells, modulo 8: cells of two texts differ by no more than the tokens in which the texts differ.
CELLS = 128
#: Pairs looked at in one numpy step.
STEP = 1 << 20
#: Pairs of larger groups are made in several tasks.
GROUP = 2048
#: The bitmap of nodes to verify has 2^NODE_BITS bits.
NODE_BITS = 24
_U = np.uint64


def _sets(batches, words, min_words):
    """(ids, keys, bounds, tokens) of each batch, each set once per task."""
    seen: set[int] = set()
    for b in batches:
        which, bounds, tokens = shingle_sets(b.column(1).to_pylist(), words, min_words)
        keys = set_keys(bounds, tokens)
        new = []
        for k, x in enumerate(keys.tolist()):
            if x not in seen:
                seen.add(x)
                new.append(k)
        yield b.column(0), which, keys, bounds, tokens, np.array(new, dtype=np.int64)


def _scan(docs: DataFrame, words: int, min_words: int) -> tuple[np.ndarray, float, DataFrame]:
    """Texts per cell of token hashes over all texts, an upper bound of each token's frequency; their sum; (doc, node)."""
    size, block = 1 << COUNT_BITS, (1 << COUNT_BITS) // BLOCKS
    kind = docs.schema["_d"].dataType.simpleString()
    doc_type = to_arrow_type(docs.schema["_d"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "node", "block", "near", "cells"]
        cells = np.zeros(size, dtype=np.int64)
        for ids, which, keys, bounds, tokens, new in _sets(batches, words, min_words):
            if not len(which):
                continue
            pick = np.zeros(len(bounds) - 1, dtype=bool)
            pick[new] = True
            t = tokens[np.repeat(pick, np.diff(bounds))]
            cells += np.bincount((t & _U(size - 1)).astype(np.int64), minlength=size)
            none = pa.nulls(len(which), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(keys), none, none, pa.nulls(len(which), pa.binary())], names)
        if cells.any():
            packed = [zlib.compress(cells[k * block : (k + 1) * block].astype(np.uint32).tobytes(), 1) for k in range(BLOCKS)]
            near = pa.array([TaskContext.get().partitionId() // NEAR] * BLOCKS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, doc_type), pa.nulls(BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), near, pa.array(packed, pa.binary())], names)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, dtype=np.uint64)
        for x in table.column("cells"):
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)
        return pa.table({"block": table.column("block").combine_chunks().slice(0, 1), "cells": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})

    rows = checkpointed(docs.mapInArrow(count, f"doc {kind}, node bigint, block int, near int, cells binary"))
    near = rows.where("block is not null").select("block", "near", "cells").groupBy("block", "near").applyInArrow(add, "block int, cells binary")
    cells = np.zeros(size, dtype=np.uint32)
    for r in near.groupBy("block").applyInArrow(add, "block int, cells binary").collect():  # BLOCKS rows, of 4 MB together
        cells[r.block * block : (r.block + 1) * block] = np.frombuffer(zlib.decompress(r.cells), dtype=np.uint32)
    return cells, float(cells.sum(dtype=np.float64)), rows.where("block is null").select("doc", "node").distinct()


def _sketches(owner: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts its tokens per cell, modulo 8: two words of 64 cells for each of three binary digits."""
    out = np.empty((n, 3 * CELLS // 64), dtype=_U)
    cell = (mix(tokens) >> _U(57)).astype(np.int64)
    for k in range(0, n, 2048):
        m = min(2048, n - k)
        lo, hi = np.searchsorted(owner, [k, k + m])
        counts = np.bincount((owner[lo:hi] - k) * CELLS + cell[lo:hi], minlength=m * CELLS).reshape(m, CELLS)
        for d in range(3):
            out[k : k + m, 2 * d : 2 * d + 2] = np.packbits((counts >> d & 1).astype(np.uint8), axis=1).view(_U)
    return out


def _differ(bits: np.ndarray, x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """By how much the cells of word w of texts x and y differ, together; each by the shorter way round the circle of 8."""
    a0, a1, a2 = (bits[x, 2 * d + w] for d in range(3))
    b0, b1, b2 = (bits[y, 2 * d + w] for d in range(3))
    lend = ~a0 & b0
    d0, d1 = a0 ^ b0, a1 ^ b1 ^ lend
    d2 = a2 ^ b2 ^ ((~a1 & b1) | (~(a1 ^ b1) & lend))
    count = lambda v: np.bitwise_count(v).astype(np.int64)
    # A difference of 4 or more counts as 8 less it.
    return count(d0 & ~d2) + 2 * count(d1 & ~d2) + 4 * count(d2) - count(d0 & d2) - 2 * count(d1 & d2)


def _planes(x: np.ndarray) -> bytes:
    """32 bit numbers as their lower halves and then their upper ones, which are mostly zeros and compress to nothing."""
    return (x & 0xFFFF).astype(np.uint16).tobytes() + (x >> 16).astype(np.uint16).tobytes()


def _unplaned(data: bytes, at: int, k: int) -> np.ndarray:
    half = np.frombuffer(data, np.uint16, 2 * k, at).astype(np.int64)
    return half[:k] | half[k:] << 16


def _packed(keys: np.ndarray, n: np.ndarray, bits: np.ndarray, counts: np.ndarray, sig: np.ndarray, left: np.ndarray) -> bytes:
    """Texts (key, size, sketch, number of entries) and their entries (32 bits of the token, tokens left) without any padding."""
    return np.array([len(keys), len(sig)], np.int64).tobytes() + keys.tobytes() + bits.tobytes() + sig.astype(np.uint32).tobytes() + _planes(n) + _planes(counts) + _planes(left)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    m, t = (int(x) for x in np.frombuffer(data, np.int64, 2))
    at = 16
    keys = np.frombuffer(data, np.int64, m, at)
    bits = np.frombuffer(data, _U, m * 3 * CELLS // 64, at := at + 8 * m).reshape(m, -1)
    sig = np.frombuffer(data, np.uint32, t, at := at + 3 * CELLS // 8 * m)
    n = _unplaned(data, at := at + 4 * t, m)
    counts = _unplaned(data, at := at + 4 * m, m)
    return keys, n, bits, counts, sig, _unplaned(data, at + 4 * m, t)


def _buckets(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Levels of text sizes: the least size of each, and the buckets of its frequent tokens.

    Texts of the threshold are of one level or of two that follow one another. A text of a level has more than its buckets'
    number of tokens, by enough that combinations within the buckets always outnumber the tokens that may be unshared.
    """
    least = np.append(1, np.ceil(5.25 * 4.0 ** np.arange(20)).astype(np.int64))
    return least, np.maximum(1, np.floor(threshold * least + 1e-9).astype(np.int64) - 1)


def _entries(owner: np.ndarray, tokens: np.ndarray, df: np.ndarray, rarity: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(text, signature, bound of the tokens shared, bound of its texts) of texts whose tokens stand in the order of rarity.

    The rare tokens at the head of a text are signatures themselves. If they are fewer than the tokens that may be unshared and
    one, the prefix is extended into the frequent tokens, which fall into buckets by their hash: two of a bucket together are a
    signature. A bucket of c prefix tokens still shows a signature after any c - 2 of them are lost, so the prefix ends where
    rare tokens and tokens behind the first of their bucket together outnumber what may be unshared. Of two texts of the
    threshold, the one whose prefix ends first has a rare token or two tokens of a bucket in common with the other's prefix.
    """
    start = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(tokens)) - start
    need = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    rare = rarity <= (np.array([RARE], np.float32).view(np.uint32)[0] >> 16)
    s = np.bincount(owner[rare], minlength=len(n))
    alone = rare & (place < need[owner])
    out = [(owner[alone], mix(tokens[alone]), (n[owner] - place)[alone], df[alone])]
    rest = np.flatnonzero(~rare & (s < need)[owner])
    if len(rest):
        least, buckets = _buckets(threshold)
        level = np.searchsorted(least, n, side="right") - 1
        # The larger of two texts takes part at the level of the smaller as well.
        both = (level > 0) & (threshold * n <= least[level] - 1 + 1e-9)
        again = rest[both[owner[rest]]]
        at = np.concatenate([rest, again])
        lower = np.repeat([0, 1], [len(rest), len(again)])
        o = owner[at]
        lev = level[o] - lower
        unit = 2 * o + lower
        by = np.lexsort((place[at], unit))
        at, o, lev, unit = at[by], o[by], lev[by], unit[by]
        bucket = ((mix(tokens[at] ^ _U(0x5BD1E995)) >> _U(20)) % buckets[lev].astype(_U)).astype(np.int64)
        home = np.lexsort((np.arange(len(at)), bucket, unit))
        first = np.flatnonzero(np.append(True, (unit[home][1:] != unit[home][:-1]) | (bucket[home][1:] != bucket[home][:-1])))
        rank = np.empty(len(at), np.int64)
        rank[home] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        # Small texts' frequent tokens are signatures alone.
        single = lev == 0
        gain = (single | (rank > 0)).astype(np.int64)
        total = np.cumsum(gain)
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        before = total - gain - np.repeat((total - gain)[begin], np.diff(np.append(begin, len(at))))
        inside = before < (need - s)[o]
        # Prefix tokens of a bucket are the first of it, so each meets all those before it.
        mates = np.where(inside & ~single, rank, 0)[home]
        later = np.repeat(np.arange(len(home)), mates)
        earlier = later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(mates) - mates, mates))
        x, y = home[earlier], home[later]
        with np.errstate(over="ignore"):
            two = mix(mix(tokens[at[x]]) * _U(0xC2B2AE3D27D4EB4F) + tokens[at[y]] * _U(0x165667B19E3779F9) + lev[x].astype(_U))
            one = mix(mix(tokens[at]) + _U(0xD6E8FEB86659FD93))
        # Texts that share a rare token are found by it; others share at most what is left behind their rare tokens.
        out.append((o[x], two, (n - s)[o[x]], df[at[x]]))
        few = inside & single
        out.append((o[few], one[few], (n - s)[o[few]], df[at[few]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _prefix_rows(docs: DataFrame, words: int, min_words: int, threshold: float, cells, parts: int) -> DataFrame:
    """(part, data): the signatures of the texts of each batch, dealt to parts.

    Tokens are ordered by their cells' counts and then by themselves, alike in all texts. An entry is 32 bits of the signature
    beside its part, and a bound of the tokens shared; signatures that agree in these bits by chance only make more candidates.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.value
        for _, _, keys, bounds, tokens, new in _sets(batches, words, min_words):
            if not len(new):
                continue
            fresh = np.zeros(len(keys), dtype=bool)
            fresh[new] = True
            tokens, keys, n = tokens[np.repeat(fresh, np.diff(bounds))], keys[fresh], np.diff(bounds)[fresh]
            owner = np.repeat(np.arange(len(n)), n)
            bits = _sketches(owner, tokens, len(n))
            df = held[(tokens & _U((1 << COUNT_BITS) - 1)).astype(np.int64)]
            # Upper bits of a float rise with it; equal keys stay in the order of the tokens.
            rarity = df.astype(np.float32).view(np.uint32) >> 16
            order = np.argsort((owner.astype(_U) << _U(47)) | (rarity.astype(_U) << _U(32)) | (tokens & _U(0xFFFFFFFF)), kind="stable")
            o, sig, left, df = _entries(owner, tokens[order], df[order].astype(np.int64), rarity[order], n, threshold)
            # A long posting: its texts are dealt to blocks, and each goes to all pairs of blocks that hold its own.
            blocks = -(-df // BLOCK)
            copies = np.repeat(np.arange(len(o)), blocks)
            with np.errstate(over="ignore"):
                other = (np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(_U)
                own = mix(keys[o[copies]].astype(_U)) % blocks[copies].astype(_U)
                sig = np.where(blocks[copies] > 1, mix(sig[copies] + np.minimum(own, other) * _U(0xC2B2AE3D27D4EB4F) + np.maximum(own, other) * _U(0x165667B19E3779F9)), sig[copies])
            o, left = o[copies], left[copies]
            part = ((sig & _U(0xFFFFFF)) % _U(parts)).astype(np.int64)
            by = np.argsort(part * len(n) + o, kind="stable")
            part, o, left, sig = part[by], o[by], left[by], (sig[by] >> _U(24)).astype(np.uint32)
            first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (o[1:] != o[:-1])))
            counts, who, where = np.diff(np.append(first, len(o))), o[first], part[first]
            starts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            data = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(where)]):
                w = who[lo:hi]
                here = slice(first[lo], first[hi] if hi < len(first) else len(o))
                data.append(_packed(keys[w], n[w], bits[w], counts[lo:hi], sig[here], left[here]))
            yield pa.RecordBatch.from_arrays([pa.array(where[starts].astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])

    return docs.mapInArrow(emit, "part int, data binary")


def candidates(rows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b), a < b: pairs of nodes that may reach the threshold, among them all that do.

    A pair that does has a signature in common: its first common token, if that is rare, else two frequent tokens. What is left
    from there on bounds what it shares, so each text of a posting, sorted by size, meets a range of larger ones. Differing
    sketches bound what it doesn't share.
    """
    grow = (1 + threshold) / threshold

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [_unpacked(x.as_py()) for b in batches for x in b.column(1)]
        if not blobs:
            return
        node, n, bits, counts, sig, left = (np.concatenate(x) for x in zip(*blobs))
        del blobs
        row = np.repeat(np.arange(len(node), dtype=np.int32), counts)
        order = np.lexsort((node[row], n[row], sig))
        row, sig, left = row[order], sig[order], left[order]
        # Copies of a text come from several tasks: one of them stands in a posting.
        one = np.append(True, (sig[1:] != sig[:-1]) | (node[row[1:]] != node[row[:-1]]))
        row, sig, left = row[one], sig[one], left[one]
        size = n[row]
        # The largest partner that a text may have by this signature.
        most = np.floor(left * grow + 1e-6).astype(np.int64) - size
        run = np.cumsum(np.append(0, sig[1:] != sig[:-1]))
        span = int(size.max()) + 2
        upto = np.searchsorted(run * span + size, run * span + np.minimum(most, span - 1), side="right")
        count = np.maximum(upto - np.arange(len(row)) - 1, 0)
        del sig, left, run, upto, order, one
        ends = np.cumsum(count)
        seen, k = [], 0
        while k < len(row):
            # As many texts as make STEP pairs, one at least.
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP)))
            c = count[k:to]
            x = np.repeat(np.arange(k, to), c)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            ok = size[x] <= most[y]
            x, y = row[x[ok]].astype(np.int64), row[y[ok]].astype(np.int64)
            room = n[x] + n[y] - 2 * np.ceil((n[x] + n[y]) / grow - 1e-6).astype(np.int64)
            differ = np.zeros(len(x), dtype=np.int64)
            for w in range(CELLS // 64):
                differ += _differ(bits, x, y, w)
                ok = differ <= room
                x, y, room, differ = x[ok], y[ok], room[ok], differ[ok]
            ok = node[x] != node[y]
            seen.append(np.unique(np.minimum(x, y)[ok] * len(node) + np.maximum(x, y)[ok]))
            if len(seen) > 64:
                seen = [np.unique(np.concatenate(seen))]
            k = to
        both = np.unique(np.concatenate(seen))
        a, b = node[both // len(node)], node[both % len(node)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartitionById(parts, "part").mapInArrow(pairs, "a bigint, b bigint").distinct()


def _bitmap(pairs: DataFrame) -> bytes:
    """The nodes of pairs as a bitmap of fixed size, of which a node's bit is set for certain."""
    size = 1 << NODE_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            for k in (0, 1):
                bits[b.column(k).to_numpy() & (size - 1)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // NEAR], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["near", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(size // 8, dtype=np.uint8)
        for x in table.column("bits"):
            total |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        return pa.table({"near": pa.array([0], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "near int, bits binary"
    got = pairs.mapInArrow(mark, kind).groupBy("near").applyInArrow(join, kind).groupBy("near").applyInArrow(join, kind).collect()  # one row of 2 MB
    return zlib.decompress(got[0].bits) if got else bytes(size // 8)


def _verified(docs: DataFrame, pairs: DataFrame, words: int, min_words: int, threshold: float) -> DataFrame:
    """The pairs whose sets have the similarity. Sets travel as sorted 32 bit hashes."""

    marked = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs))
    release(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(marked.value, dtype=np.uint8)).astype(bool)
        for _, _, keys, bounds, tokens, new in _sets(batches, words, min_words):
            new = new[bits[keys[new] & (len(bits) - 1)]]
            if len(new):
                t = mix(tokens).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array([t[bounds[k] : bounds[k + 1]].tobytes() for k in new.tolist()], pa.binary())], ["node", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
                if min(len(s), len(t)) < threshold * max(len(s), len(t)) - 1e-9:
                    ok.append(False)
                    continue
                both = np.concatenate((s, t))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(shared >= threshold * (len(s) + len(t) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    held = checkpointed(docs.mapInArrow(sets, "node bigint, tokens binary"))
    release(docs.sparkSession)
    # A node's set is the same from every task, so any of them will do. The join takes over this partitioning.
    held = held.dropDuplicates(["node"])
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    two = one.join(held.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc: str = "scrape_id", text: str = "content", words: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """(doc, group_id, links): one row per document that takes part, with its group and the links of its text.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of the threshold or more; a group is
    all that is linked directly or through others. Texts with the same set are one node from the start. Null texts,
    and those of fewer than min_words or `words` words, take no part. Repeated rows count once.
    """
    base = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).where("_t is not null")
    cells, tokens, members = _scan(base, words, min_words)
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    parts = max(1, math.ceil(tokens * (1 - threshold) / PART))
    pairs = checkpointed(candidates(_prefix_rows(base, words, min_words, threshold, shared, parts), threshold, parts))
    release(docs.sparkSession)
    links = checkpointed(_verified(base, pairs, words, min_words, threshold))
    release(docs.sparkSession)
    label = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    out = members.join(label, "node", "left").join(degree, "node", "left")
    return out.select(F.col("doc").alias(doc), F.coalesce("label", "node").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def group_pairs(groups: DataFrame, doc: str = "scrape_id") -> DataFrame:
    """(doc_a, doc_b): all pairs within a group, a < b. As many rows as the result asks for.

    A group of more than GROUP documents is dealt to salts: each document meets all others, in as many tasks as there are salts.
    """
    g = groups.select("group_id", F.col(doc).alias("d")).where("d is not null").distinct()
    sizes = g.groupBy("group_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    g = g.join(sizes, "group_id")
    a = g.select("group_id", F.pmod(F.xxhash64("d"), "salts").cast("int").alias("salt"), F.col("d").alias(f"{doc}_a"))
    b = g.select("group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("d").alias(f"{doc}_b"))
    return a.join(b, ["group_id", "salt"]).where(F.col(f"{doc}_a") < F.col(f"{doc}_b")).select(f"{doc}_a", f"{doc}_b")
