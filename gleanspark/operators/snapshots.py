"""What changed between full snapshots, by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key hash per level of the tree: 16 children a node. Levels below the root where none are given, and at most.
BITS, LEVELS, MOST_LEVELS = 4, 3, 7
#: Records of a snapshot per leaf. More would let every leaf differ where few records do.
LEAF = 4


def levels_for(rows: int, snapshots: int, bits: int = BITS) -> int:
    """Levels of a tree whose leaves hold about LEAF records of a snapshot."""
    leaves = max(1.0, rows / max(1, snapshots) / LEAF)
    return min(MOST_LEVELS, max(1, math.ceil(math.log(leaves, 1 << bits) - 1e-9)))


def _null_safe_hash(cols: Sequence[Column], seed: int) -> Column:
    """xxhash64 skips nulls, so null is told from the empty string by a flag of its own."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)])


def latest_takes(snaps: DataFrame, keys: Sequence[str], snapshot: str, content: str, taken: str, delivered: str | None) -> DataFrame:
    """One row per snapshot and record: that of its latest take, with a 256 bit digest in place of the content.

    Of takes at the same time the one delivered last holds, then the greatest digest. Columns are renamed, so
    extra columns of the input can't clash: _s, _k0.., _d (null for null content), _t.
    """
    when = [F.col(taken)] + ([F.col(delivered)] if delivered else [])
    return (
        snaps.where(F.col(snapshot).isNotNull())
        .select(F.col(snapshot).alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[w.alias(f"w{i}") for i, w in enumerate(when)], F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("d")).alias("_v"))
        .groupBy("_s", *[f"_k{i}" for i in range(len(keys))])
        .agg(F.max("_v").alias("_v"))
        .select("_s", *[f"_k{i}" for i in range(len(keys))], F.col("_v.d").alias("_d"), F.col("_v.w0").alias("_t"))
    )


def merkle_leaves(latest: DataFrame, n_keys: int, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(_s, _b, digest) per snapshot and hash range. A digest is order-free: two sums and a count of row hashes."""
    keys = [F.col(f"_k{i}") for i in range(n_keys)]
    return (
        latest.select("_s", bucket(n_keys, bits, levels).alias("_b"), _null_safe_hash([*keys, F.col("_d")], 11).alias("h1"), _null_safe_hash([*keys, F.col("_d")], 23).alias("h2"))
        .groupBy("_s", "_b")
        .agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n"))
    )


def bucket(n_keys: int, bits: int = BITS, levels: int = LEVELS) -> Column:
    return F.shiftrightunsigned(_null_safe_hash([F.col(f"_k{i}") for i in range(n_keys)], 7), 64 - bits * levels)


def differing_buckets(leaves: DataFrame, pairs: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(_p, _c, _b): the leaves that differ between the snapshots of a pair, found from the root down.

    Below a node whose digests agree nothing is compared. The tables hold at most snapshots x leaves rows, whatever
    the number of records.
    """
    alive = pairs
    for level in range(levels + 1):
        shift = bits * (levels - level)
        node = leaves.groupBy("_s", F.shiftrightunsigned("_b", shift).alias("_b")).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("n").alias("n"))
        both = pairs.select(F.posexplode(F.array("_p", "_c")).alias("side", "_s"), "_p", "_c").join(node, "_s")
        held = [F.sum(F.when(F.col("side") == s, F.col(x)).otherwise(0)).alias(f"{x}{s}") for x in ("x1", "x2", "n") for s in (0, 1)]
        grown = both.groupBy("_p", "_c", "_b").agg(*held).where("x10 <> x11 or x20 <> x21 or n0 <> n1").select("_p", "_c", "_b")
        if level:
            parent = alive.select("_p", "_c", F.col("_b").alias("_up"))
            grown = grown.withColumn("_up", F.shiftrightunsigned("_b", bits)).join(parent, ["_p", "_c", "_up"], "left_semi").drop("_up")
        alive = grown
    return alive


def snapshot_changes(
    snaps: DataFrame,
    keys: Sequence[str] = ("url", "options_fingerprint"),
    snapshot: str = "snapshot_no",
    content: str = "content",
    taken: str = "scraped_at",
    delivered: str | None = "delivered_at",
    with_diff: bool = False,
    max_lines: int | None = None,
) -> DataFrame:
    """Records added, removed or changed between each delivered snapshot and the one before it.

    Returns snapshot, keys, change_status, previous_scrape_at and, with_diff, added and removed: the distinct
    non-blank trimmed lines of the new and the old content that the other lacks, in order, max_lines of each if given. Rows
    of unchanged hash ranges are never compared; contents are read only for records that changed. Levels of the tree
    follow from the number of rows.

    Nulls: rows without a snapshot number belong to none; null keys are values like others; null content equals null
    alone, and the empty text differs from it. A null scrape time is earlier than any. Repeated rows count once. The
    first snapshot, and an empty table, give no rows. Gaps in the numbers are passed over.
    """
    n = len(keys)
    ks = [f"_k{i}" for i in range(n)]
    latest = latest_takes(snaps, keys, snapshot, content, taken, delivered)
    numbers = snaps.select(F.col(snapshot).alias("_c")).where("_c is not null").distinct()
    pairs = numbers.select(F.lag("_c").over(Window.orderBy("_c")).alias("_p"), "_c").where("_p is not null")
    levels = levels_for(snaps.count(), numbers.count())
    alive = differing_buckets(merkle_leaves(latest, n, BITS, levels), pairs, BITS, levels)
    sides = alive.select("_p", "_c", "_b", F.posexplode(F.array("_p", "_c")).alias("_side", "_s"))
    rows = latest.withColumn("_b", bucket(n, BITS, levels)).join(sides, ["_s", "_b"])
    new, old = F.col("_side") == 1, F.col("_side") == 0
    diff = (
        rows.groupBy("_p", "_c", *ks)
        .agg(F.max(new).alias("is_new"), F.max(old).alias("is_old"), F.max(F.when(new, F.col("_d"))).alias("dn"), F.max(F.when(old, F.col("_d"))).alias("do"), F.max(F.when(old, F.col("_t"))).alias("previous_scrape_at"))
        .withColumn("change_status", F.when(~F.col("is_old"), "new").when(~F.col("is_new"), "removed").when(~F.col("dn").eqNullSafe(F.col("do")), "changed"))
        .where("change_status is not null")
    )
    names = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    if not with_diff:
        return diff.select(F.col("_c").alias(snapshot), *names, "change_status", "previous_scrape_at")
    return _with_lines(snaps, diff, keys, snapshot, content, max_lines)


def _with_lines(snaps: DataFrame, diff: DataFrame, keys: Sequence[str], snapshot: str, content: str, max_lines: int | None = None) -> DataFrame:
    """Adds the lines. Contents are fetched by snapshot, key and digest, for the changed records only."""
    from gleanspark.functions.text import js_trim

    ks = [f"_k{i}" for i in range(len(keys))]
    need = diff.select("_p", "_c", *ks, F.explode(F.array(F.struct(F.col("_p").alias("s"), F.col("do").alias("d"), F.lit(0).alias("side")), F.struct(F.col("_c").alias("s"), F.col("dn").alias("d"), F.lit(1).alias("side")))).alias("x")).select("_p", "_c", *ks, "x.*").where("d is not null")
    texts = snaps.select(F.col(snapshot).alias("ts"), *[F.col(k).alias(f"t{i}") for i, k in enumerate(keys)], F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("td"), F.col(content).alias("text"))
    on = [need.s == texts.ts, need.d == texts.td, *[need[k].eqNullSafe(texts[f"t{i}"]) for i, k in enumerate(ks)]]
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col("text"), "\n"), js_trim), lambda x: x != ""))
    got = need.join(texts, on).groupBy("_p", "_c", *ks).agg(F.max(F.when(F.col("side") == 1, lines)).alias("ln"), F.max(F.when(F.col("side") == 0, lines)).alias("lo"))
    empty = F.array().cast("array<string>")
    renamed = got.select(F.col("_p").alias("gp"), F.col("_c").alias("gc"), *[F.col(k).alias(f"g{k}") for k in ks], F.coalesce("ln", empty).alias("ln"), F.coalesce("lo", empty).alias("lo"))
    back = diff.join(renamed, [diff["_c"] == renamed.gc, *[diff[k].eqNullSafe(renamed[f"g{k}"]) for k in ks]], "left")
    some = lambda c: F.coalesce(c if max_lines is None else F.slice(c, 1, max_lines), empty)
    return back.select(
        F.col("_c").alias(snapshot), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "change_status", "previous_scrape_at",
        some(F.array_except("ln", "lo")).alias("added"), some(F.array_except("lo", "ln")).alias("removed"),
    )


def unified_diffs(snaps: DataFrame, keys: Sequence[str] = ("url", "options_fingerprint"), snapshot: str = "snapshot_no", content: str = "content", taken: str = "scraped_at", delivered: str | None = "delivered_at", context: int = 3) -> DataFrame:
    """(snapshot, keys, diff): the changed records of snapshot_changes with a unified diff of the old and new content. Null contents are empty."""
    import difflib
    from collections.abc import Iterator

    import pyarrow as pa

    n = len(keys)
    changed = snapshot_changes(snaps, keys, snapshot, content, taken, delivered).where("change_status = 'changed'").select(F.col(snapshot).alias("_c"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    numbers = snaps.select(F.col(snapshot).alias("_c")).where("_c is not null").distinct()
    pairs = numbers.select(F.lag("_c").over(Window.orderBy("_c")).alias("_p"), "_c").where("_p is not null")
    when = [F.col(taken)] + ([F.col(delivered)] if delivered else [])
    order = F.struct(*[w.alias(f"w{i}") for i, w in enumerate(when)], F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("d"))
    texts = snaps.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_s"), *[F.col(k).alias(f"t{i}") for i, k in enumerate(keys)], order.alias("o"), F.col(content).alias("x"))
    need = changed.join(pairs, "_c").select("_c", *[f"_k{i}" for i in range(n)], F.posexplode(F.array("_p", "_c")).alias("side", "_s"))
    got = need.join(texts, [need["_s"] == texts["_s"], *[need[f"_k{i}"].eqNullSafe(texts[f"t{i}"]) for i in range(n)]])
    best = got.groupBy("_c", *[f"_k{i}" for i in range(n)]).agg(*[F.max(F.when(F.col("side") == k, F.struct("o", "x"))).alias(name) for k, name in ((0, "old"), (1, "new"))])
    rows = best.select("_c", *[f"_k{i}" for i in range(n)], F.coalesce("old.x", F.lit("")).alias("old"), F.coalesce("new.x", F.lit("")).alias("new"))
    kinds = [snaps.schema[snapshot].dataType.simpleString(), *[snaps.schema[k].dataType.simpleString() for k in keys]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = ["\n".join(difflib.unified_diff(o.split("\n"), w.split("\n"), "previous", "current", n=context, lineterm="")) for o, w in zip(b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(made, pa.string())], [snapshot, *keys, "diff"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip([snapshot, *keys], kinds)) + ", diff string")
