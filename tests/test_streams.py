from gleanspark.plans import streams
from gleanspark.streaming import state

JOBS = "VALUES ('a', 'j1', 1, 'completed', '2024-01-01 00:00:00', '2024-01-01 00:00:01'), ('a', 'j2', 1, ' FAILED', '2024-01-01 00:00:00', '2024-01-01 00:00:30'), ('b', 'j3', 1, 'completed', '2024-01-01 00:00:00', NULL), (NULL, 'j4', 1, NULL, '2024-01-01 00:00:00', '2024-01-01 02:00:00')"


def jobs(spark, at, parts):
    """crawl_jobs.parquet under a folder: one file, or a folder of files."""
    df = spark.sql(f"SELECT crawl_id, job_id, attempt, status, CAST(ts AS timestamp) AS ts, CAST(received_at AS timestamp) AS received_at FROM {JOBS} AS t(crawl_id, job_id, attempt, status, ts, received_at)")
    df.repartition(parts).write.parquet(f"{at}/{'crawl_jobs.parquet' if parts > 1 else 'written'}")
    if parts == 1:
        next((at / "written").glob("*.parquet")).rename(at / "crawl_jobs.parquet")
    return str(at)


def test_progress_of_a_folder_of_files(spark, tmp_path):
    for name, parts in (("file", 1), ("folder", 3)):
        (tmp_path / name).mkdir()
        got = {tuple(r) for r in streams.st7_progress(spark, jobs(spark, tmp_path / name, parts)).collect()}
        assert got == {("a", 2, 1, 1), ("b", 1, 1, 0), (None, 1, 0, 0)}, name


def test_histogram_of_a_folder_of_files(spark, tmp_path):
    got = {tuple(r) for r in streams.st9_histogram(spark, jobs(spark, tmp_path, 3)).collect()}
    assert got == {("completed", 1, 1, 1, 2), ("failed", 0, 1, 1, 1), (None, 0, 0, 0, 1)}


def test_updates_of_a_stream_without_files(spark, tmp_path):
    """No file, no batch: an empty result."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("status string, ts timestamp, received_at timestamp").parquet(str(tmp_path / "in"))
    got = state.drain_updates(state.delays(stream, streams.BUCKETS), ["status"], str(tmp_path / "state"), str(tmp_path / "rows"))
    assert got.columns == ["status", *streams.BUCKETS, "n"] and got.count() == 0
