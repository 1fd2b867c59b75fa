from pyspark.sql import functions as F

from quire.llm.common import CLEAN, Scratch


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f.rsplit("/", 1)[-1] for f in files.split() if "/shuffle_" in f}


def test_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN)
    table = Scratch(spark, "common").put(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    assert not shuffle_files(spark) - before
    assert table.count() == 1000 and spark.conf.get(CLEAN) == setting
