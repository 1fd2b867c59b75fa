"""Sinks that take effect as a whole, archives that are streamed, and the log of commits."""

import io
import os
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quire.sources import sinks
from quire.sources.commits import CommitLog, Conflict


def below(folder):
    """What an export shows; hidden folders of jobs don't count."""
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names if "/.staged-" not in d}


def test_files_replace_old_ones(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.txt", f"text {i}".encode()) for i in range(30)], "path string, content binary").repartition(5)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path / 'b'}"):
        sinks.write_files(rows, folder)
        sinks.write_files(rows.withColumn("content", F.lit(b"new")).where("path = 'd0/0.txt'"), folder)
    for name in ("a", "b"):
        found = below(tmp_path / name)
        assert len(found) == 30 and found["d0/0.txt"] == b"new" and found["d1/1.txt"] == b"text 1"


@pytest.mark.parametrize("bad", ["fails", "outside", "twice"])
def test_a_failing_job_changes_nothing(spark, tmp_path, bad):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.txt", i) for i in range(40)], "path string, n int").repartition(4)
    sinks.write_files(rows.select("path", F.lit(b"old").alias("content")), str(folder))
    wrong = {
        "fails": (F.col("path"), F.when(F.col("n") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).cast("binary")),
        "outside": (F.when(F.col("n") == 33, F.lit("../x")).otherwise(F.col("path")), F.lit(b"new")),
        "twice": (F.when(F.col("n") == 33, F.lit("1.txt")).otherwise(F.col("path")), F.lit(b"new")),
    }[bad]
    with pytest.raises(Exception):
        sinks.write_files(rows.select(wrong[0].alias("path"), wrong[1].alias("content")), str(folder))
    assert below(folder) == {f"{i}.txt": b"old" for i in range(40)} and not (tmp_path / "x").exists()


def test_archives_are_streamed(spark, tmp_path):
    """Members far apart in the input, of more bytes than are held at a time; mimetype first, the rest sorted."""
    rows = spark.range(60).selectExpr("concat('b', id % 3, '.epub') as path", "case when id < 3 then 'mimetype' else concat('m', lpad(id, 3, '0')) end as member", "cast(repeat('x', 200000) as binary) as content")
    sinks.write_archives(rows.repartition(7), str(tmp_path))
    for i in range(3):
        archive = zipfile.ZipFile(io.BytesIO((tmp_path / f"b{i}.epub").read_bytes()))
        names = archive.namelist()
        assert names == ["mimetype", *(f"m{j:03d}" for j in range(3, 60) if j % 3 == i)] and archive.testzip() is None
        assert archive.infolist()[0].compress_type == zipfile.ZIP_STORED and archive.infolist()[1].file_size == 200000


def test_commits(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/table")
    assert log.version() is None
    with pytest.raises(FileNotFoundError):
        log.table()
    first = lambda old: spark.createDataFrame([("a",)], "k string") if old is None else old
    assert log.commit(first, "first") == 0 and log.entry(0)["note"] == "first"
    assert not log.put_if_absent(0, {"table": "x"}) and log.version() == 0
    with ThreadPoolExecutor(4) as pool:
        add = lambda i: CommitLog(spark, f"file://{tmp_path}/table").commit(lambda old: old.union(spark.createDataFrame([(f"w{i}",)], "k string")))
        versions = list(pool.map(add, range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    assert sorted(r[0] for r in log.table().collect()) == ["a", "w0", "w1", "w2", "w3"]
    assert log.table(0).count() == 1 and log.vacuum(1) == 4 and log.table().count() == 5
    assert not [n for n in os.listdir(tmp_path / "table/_log") if n.endswith(".tmp")]


def test_a_writer_that_is_always_late(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/table")
    log.commit(lambda old: spark.range(1))

    def change(old):
        CommitLog(spark, log.folder).put_if_absent(log.version() + 1, log.entry(log.version()))
        return old

    with pytest.raises(Conflict):
        log.commit(change, attempts=2)
    assert log.table().count() == 1


def test_a_writer_that_dies_leaves_no_version(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/table")
    log.commit(lambda old: spark.range(3))
    with pytest.raises(Exception, match="lost"):
        log.commit(lambda old: old.select(F.raise_error(F.lit("lost")).cast("long").alias("id")))
    assert log.version() == 0 and log.table().count() == 3
