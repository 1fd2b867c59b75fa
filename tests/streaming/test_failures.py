import time
from contextlib import contextmanager

from quire.streaming.failures import failure_runs

SCHEMA = "key string, ts timestamp, failed boolean"


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "key string, ts string, failed boolean").selectExpr("key", "cast(ts as timestamp) ts", "failed")
    df.coalesce(1).write.mode("append").parquet(str(folder))


@contextmanager
def running(spark, tmp_path, name, **options):
    """A function that waits for so many rows of the query's output; a timer keeps the query going, so it is stopped."""
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = failure_runs(stream, **options).writeStream.format("memory").queryName(name).outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()

    def rows(n):
        until = time.time() + 60
        while time.time() < until and q.isActive and spark.table(name).count() < n:
            time.sleep(0.3)
        return [tuple(r) for r in spark.table(name).collect()]

    try:
        yield rows
    finally:
        q.stop()


def test_runs_over_a_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i}:00", f) for i, f in enumerate([True, True, True])] + [("b", "2024-01-01 00:00:00", True), ("b", "2024-01-01 00:01:00", False)]
    put(spark, tmp_path / "in", rows)
    with running(spark, tmp_path, "runs") as found:
        assert set(found(2)) == {("a", 3, True), ("b", 0, False)}


def test_cooldown_ends_by_its_timer(spark, tmp_path):
    """Three failures start a cooldown; it ends without a further event, and the run starts again."""
    put(spark, tmp_path / "in", [("a", f"2024-01-01 00:00:0{i}", True) for i in range(3)])
    with running(spark, tmp_path, "cooled", cooldown_s=2) as found:
        assert found(2) == [("a", 3, True), ("a", 0, False)]
        put(spark, tmp_path / "in", [("a", "2024-01-01 00:01:00", True)])
        assert found(3)[2] == ("a", 1, False)
