"""Reports over a library: all of them partial aggregations by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators.state import KEY, with_state


def files(segments: DataFrame) -> DataFrame:
    return segments.groupBy("book_id", "file_path").agg(F.count("*").alias("n_segments"), F.min("spine_index").alias("spine_index"))


def pending_by_file(segments: DataFrame, state: DataFrame) -> DataFrame:
    full = with_state(segments, state.select(*KEY, "status"))
    return full.groupBy("book_id", "file_path").agg(
        F.count_if(F.col("status") != "completed").alias("n_pending"),
        F.count_if(F.col("status") == "completed").alias("n_done"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
    )


def progress(segments: DataFrame, state: DataFrame) -> DataFrame:
    """Per book: files, finished files, segments and finished segments."""
    by_file = pending_by_file(segments, state)
    return by_file.groupBy("book_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("n_pending") == 0).alias("n_finished"),
        F.sum(F.col("n_pending") + F.col("n_done")).alias("n_segments"),
        F.sum("n_done").alias("n_done"),
    )


def dashboard(state: DataFrame) -> DataFrame:
    names = ("pending", "completed", "error", "skipped")
    return state.groupBy("book_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names))


def skip_counts(skips: DataFrame) -> DataFrame:
    return skips.groupBy("reason", "source").agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("n_books"))


def cascades(skips: DataFrame) -> DataFrame:
    return skips.where("source = 'cascade'").groupBy("reason").agg(F.count("*").alias("n"))


def book_stats(spine: DataFrame, toc: DataFrame, segments: DataFrame, skips: DataFrame) -> DataFrame:
    """Per book: spine and contents sizes, processed and skipped files, and the skipped share in percent."""
    a = spine.groupBy("book_id").agg(F.count("*").alias("n_spine"))
    b = toc.groupBy("book_id").agg(F.count("*").alias("n_toc"))
    c = segments.groupBy("book_id").agg(F.countDistinct("file_path").alias("n_processed"))
    d = skips.groupBy("book_id").agg(F.countDistinct("file_path").alias("n_skipped"))
    out = a.join(b, "book_id", "left").join(c, "book_id", "left").join(d, "book_id", "left").fillna(0)
    share = F.round(100.0 * F.col("n_skipped") / F.col("n_spine"), 2)
    return out.withColumn("skipped_percent", share).withColumn("warn", F.col("skipped_percent") > 50)


def pending_totals(segments: DataFrame, state: DataFrame) -> DataFrame:
    """Per book: segments to translate, those of skipped files (which stay pending for good), and records that no segment has.

    ``segments`` carry a skip_reason, as skip.tagged gives it.
    """
    full, waits = with_state(segments, state), F.col("status") == "pending"
    known = full.groupBy("book_id").agg(
        F.count_if(waits & F.col("skip_reason").isNull()).alias("n_pending"), F.count_if(waits & F.col("skip_reason").isNotNull()).alias("n_auto_skipped")
    )
    lost = state.join(segments.select(*KEY), KEY, "left_anti").groupBy("book_id").agg(F.count("*").alias("n_orphans"))
    return known.join(lost, "book_id", "full").fillna(0)


def library_totals(spine: DataFrame, skips: DataFrame) -> DataFrame:
    """One row: books read, and those with skipped files."""
    books = spine.select("book_id").distinct().join(skips.select("book_id", F.lit(1).alias("hit")).distinct(), "book_id", "left")
    return books.agg(F.count("*").alias("n_processed"), F.count("hit").alias("n_with_skips"))


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first rows of a report: errors, pending segments, covers."""
    return rows.orderBy(*order).limit(n)


def top_titles(titles: DataFrame, n: int) -> DataFrame:
    """The most frequent titles; ties in the order of the titles."""
    return titles.groupBy("norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "norm").limit(n)


def collisions(segments: DataFrame) -> DataFrame:
    """Ids that several segments share."""
    return segments.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def language_votes(samples: DataFrame) -> DataFrame:
    """(book_id, language): the most frequent of each book's samples ``(book_id, pos, language)``; ties to the first seen."""
    counted = samples.groupBy("book_id", "language").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("book_id").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))
