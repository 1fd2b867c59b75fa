"""The corpus pipeline: language ID, quality rules, near-dedup, repeat removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.

Edge cases: null, empty and letterless texts go in the first stage, texts under 50 words in the second; null and repeated ids are
kept apart by their rows; texts of any length are read whole; further columns are left out, whatever their names; without labels only the
base rules decide; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import langid, nearcopies, packing, quality, repeats
from quire.llm.common import Scratch

#: Bits a byte above which a text isn't in any of the learned languages, and from how many bytes on that can be told.
FOREIGN_BITS, TELLING_BYTES = 5.0, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and longer texts that no learned language explains."""
    parser = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    found = langid.identify(docs, parser, keep=("text", "lang", "source", "n_chars"))
    foreign = (F.col("bits") > FOREIGN_BITS) & (F.octet_length("text") >= TELLING_BYTES)
    return found.where((F.col("lang_pred") != langid.UND) & ~foreign).select("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the decision list, learned from ``labels``, reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = labels.where("quality is not null and doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(20000)  # the bound of the learner's sample, and of this broadcast
    learned = quality.learn(quality.statistics(docs.join(F.broadcast(ids), "doc_id")), labels)
    measured = quality.statistics(docs, keep=("text", "lang", "source", "n_chars"))
    return measured.where(quality.verdict(learned)).select("doc_id", "text", "lang", "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, whatever its id.

    Near copies share 0.8 of their five-word shingles. The row with the smallest id stays, one without an
    id only where the component has no other; different texts under one id are rows of their own.
    """
    columns = ("doc_id", "lang", "source", "n_chars")
    found = nearcopies.components(docs, keep=columns).withColumn("row", F.monotonically_increasing_id())
    found = Scratch(spark, "near").put(found, "roots")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    stay = found.groupBy("root").agg(F.min(order).alias("first")).select("first.row")
    return found.join(stay, "row", "left_semi").select("doc_id", "text", "lang", "source", "n_chars")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that lie in a repeated string of 200 bytes."""
    cut = repeats.remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each text, with its place in a sequence."""
    return packing.pack(docs, F.xxhash64(F.lower("text")))


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
