"""Streams with state: visited addresses, windows of counts, sessions, and files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from gleanspark.functions import urls as U


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of files."""
    at = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(at)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """The event time as a TIMESTAMP, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def first_visits(jobs: DataFrame, ts: str = "ts", within: str = "24 hours") -> DataFrame:
    """Each address of a crawl once within the time, by its normal form. Rows without an address are passed over."""
    keyed = timed(jobs, ts).where("url is not null").withColumn("url_key", U.crawl_key(F.col("url")))
    return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["crawl_id", "url_key"])


def windowed_counts(events: DataFrame, keys: list[str], length: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window: quotas by the day, rates by the minute, throughput by the hour."""
    w = timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("window.start").alias("start"), "n")


def idle_sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    w = timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read the result. Both folders must be shared by the executors."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], checkpoint: str, out: str) -> DataFrame:
    """Run a stream of updates over what there is and read the last state of each key. Both folders must be shared."""

    def batch(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    kind = S.StructType([*stream.schema.fields, S.StructField("_batch", S.IntegerType())])
    # A stream without files writes no batch; this one, of no rows, is there to be read then.
    stream.sparkSession.createDataFrame([], kind).write.mode("overwrite").parquet(f"{out}/batch=none")
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    rest = [c for c in stream.columns if c not in keys]
    got = stream.sparkSession.read.schema(kind).parquet(f"{out}/batch=*")
    return got.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def delays(jobs: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Cumulative buckets of seconds between an attempt and its arrival, per status, as they grow."""
    s = jobs.withColumn("status", F.lower(F.trim("status"))).withColumn("s", (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    return s.groupBy("status").agg(*[F.count_if(F.col("s") <= b).alias(n) for n, b in bounds.items()], F.count("*").alias("n"))


def progress(jobs: DataFrame) -> DataFrame:
    """Attempts of each crawl, and how many of them ended well or badly, as they arrive."""
    s = F.lower(F.trim("status"))
    return jobs.groupBy("crawl_id").agg(F.count("*").alias("attempts"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"))


def changes(snapshots: DataFrame, ttl_days: int = 30, ts: str = "scraped_at") -> DataFrame:
    """(url, options_fingerprint, scraped_at, change_status) of takes as they come: new, same or changed against the take before.

    A take that is older than the time to live is forgotten: what follows is new, and its state goes with the watermark.
    Takes of one batch are put in the order of their times. Only hashes of contents are kept.
    """
    rows = timed(snapshots, ts).where(F.col(ts).isNotNull()).withWatermark(ts, f"{ttl_days} days").select("url", "options_fingerprint", ts, F.sha2("content", 256).alias("h"))
    keep = ttl_days * 86_400_000

    def fold(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        x = pd.concat(list(frames), ignore_index=True)
        x["h"] = x["h"].fillna("")
        x = x.sort_values([ts, "h"], kind="stable").drop_duplicates([ts, "h"])
        out = []
        for at, h in zip(x[ts], x["h"]):
            ms = int(at.timestamp() * 1000)
            fresh = held is None or ms - held[1] > keep
            out.append("new" if fresh else "same" if h == held[0] else "changed")
            held = (h, ms)
        state.update(held)
        state.setTimeoutTimestamp(max(held[1], state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame({"url": key[0], "options_fingerprint": key[1], ts: x[ts], "change_status": out})

    kind = f"url string, options_fingerprint string, {ts} timestamp, change_status string"
    return rows.groupBy("url", "options_fingerprint").applyInPandasWithState(fold, kind, "h string, at bigint", "append", "EventTimeTimeout")


def proxies(log: DataFrame, failures: int = 3, cooldown_ms: int = 60_000) -> DataFrame:
    """(proxy, job_id, attempt, status, failures, cooling_until) behind each request as it comes; the state is two numbers a proxy.

    log has proxy, ts, job_id, attempt, status and ok; requests of one batch are put in order.
    """

    def fold(key, frames, state):
        import pandas as pd

        fails, until = state.get if state.exists else (0, 0)
        x = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "job_id", "attempt", "status"], kind="stable")
        out = []
        for at, ok in zip(x["ts"], x["ok"]):
            if ok:
                fails, until = 0, 0
            else:
                fails += 1
                if fails == failures:
                    fails, until = 0, at.value // 1000 + cooldown_ms * 1000
            out.append((fails, pd.Timestamp(until * 1000) if until else pd.NaT))
        state.update((fails, until))
        yield pd.DataFrame({"proxy": key[0], "job_id": x["job_id"], "attempt": x["attempt"], "status": x["status"], "failures": [o[0] for o in out], "cooling_until": pd.to_datetime(pd.Series([o[1] for o in out], index=x.index))})

    kind = "proxy int, job_id string, attempt int, status string, failures int, cooling_until timestamp"
    return log.groupBy("proxy").applyInPandasWithState(fold, kind, "failures int, until bigint", "append", "NoTimeout")
