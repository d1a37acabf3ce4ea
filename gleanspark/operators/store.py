"""A store of named rows on tables: the latest version of each key holds, removals are versions too, and rows may expire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """The last version of each key. Of versions alike in all but other columns the greatest row holds; null keys are one key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in versions.columns if c not in keys]
    row = F.struct(version, *[c for c in rest if c != version])
    return versions.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*versions.columns)


def put(store: DataFrame, changes: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """The store with changes; columns that either side lacks are null there."""
    return latest(store.unionByName(changes, allowMissingColumns=True), key, version)


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without some keys. Null keys match null ones."""
    on = [store[c].eqNullSafe(keys[c]) for c in keys.columns]
    test = on[0]
    for x in on[1:]:
        test = test & x
    return store.join(keys, test, "left_anti")


def lifecycle(jobs: DataFrame, crawl: str = "crawl_id", status: str = "status", at: str = "ts", idle: str = "INTERVAL 24 HOURS", now: Column | None = None) -> DataFrame:
    """(crawl, created_at, last_at, state): cancelled if any job was, expired if idle too long, done if no job is open, else active."""
    s = F.lower(F.trim(status))
    g = jobs.groupBy(crawl).agg(F.min(at).alias("created_at"), F.max(at).alias("last_at"), F.bool_or(s.isin("cancelled", "canceled")).alias("c"), F.countDistinct("job_id").alias("n"), F.count_distinct(F.when(s.isin("completed", "failed"), F.col("job_id"))).alias("d"))
    clock = now if now is not None else F.current_timestamp()
    state = F.when(F.coalesce("c", F.lit(False)), "cancelled").when(F.col("d") == F.col("n"), "done").when(F.col("last_at") < clock - F.expr(idle), "expired").otherwise("active")
    return g.select(crawl, "created_at", "last_at", state.alias("state"))
