"""Chapters from a table of contents, by forward fill along the spine instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.paths import file_of
from quire.functions.text import title_from_path


def contents(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """(book_id, spine_index, file_path, title): the first entry of each file; its href if untitled."""
    on = toc.withColumn("file_path", file_of(F.col("href"))).join(spine.select("book_id", "file_path", "spine_index"), ["book_id", "file_path"])
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("file_path"))
    return on.groupBy("book_id", "spine_index", "file_path").agg(F.min_by(title, "pos").alias("title"))


def titles_by_file(toc: DataFrame) -> DataFrame:
    """(book_id, file_path, title): the first title that isn't empty, else an empty one."""
    on = toc.withColumn("file_path", file_of(F.col("href"))).where("file_path <> ''")
    titled = F.when(F.trim("title") != "", F.col("title"))
    return on.groupBy("book_id", "file_path").agg(
        F.coalesce(F.min_by(titled, F.when(titled.isNotNull(), F.col("pos"))), F.lit("")).alias("title"),
    )


def filled(spine: DataFrame, starts: DataFrame) -> DataFrame:
    """Spine rows with the start that governs them (null before the first), and the book's last start."""
    marks = starts.select("book_id", "spine_index", F.struct(F.col("spine_index").alias("start"), F.col("file_path").alias("file"), "title").alias("mark"))
    along = Window.partitionBy("book_id").orderBy("spine_index")
    joined = spine.join(marks, ["book_id", "spine_index"], "left")
    return joined.withColumn("block", F.last("mark", ignorenulls=True).over(along)).withColumn(
        "last_start", F.max(F.when(F.col("mark").isNotNull(), F.col("spine_index"))).over(Window.partitionBy("book_id"))
    )


def markdown_blocks(spine: DataFrame, toc: DataFrame, with_text: DataFrame) -> DataFrame:
    """(book_id, start, title, files): from an entry to before the next one; earlier files stand alone.

    ``with_text(book_id, file_path)``: files that have segments.
    """
    rows = filled(spine, contents(toc, spine)).join(with_text.select("book_id", "file_path").distinct(), ["book_id", "file_path"], "left_semi")
    alone = F.struct(F.col("spine_index").alias("start"), F.col("file_path").alias("file"), title_from_path(F.col("file_path")).alias("title"))
    rows = rows.withColumn("block", F.coalesce("block", alone))
    grouped = rows.groupBy("book_id", F.col("block.start").alias("start"), F.col("block.title").alias("title"))
    files = F.transform(F.sort_array(F.collect_list(F.struct("spine_index", "file_path"))), lambda x: x["file_path"])
    return grouped.agg(files.alias("files"))


def audio_chapter_of(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, file_path, spine_index, chapter_file, title): what lies before the first entry or behind
    the last one belongs to no chapter; a book without entries has a chapter a file."""
    starts = contents(toc, spine)
    named = titles_by_file(toc)
    starts = starts.drop("title").join(named, ["book_id", "file_path"])
    rows = filled(spine, starts)
    inside = rows.where("last_start is null or (block is not null and spine_index <= last_start)")
    return inside.select(
        "book_id", "file_path", "spine_index",
        F.coalesce(F.col("block.file"), F.col("file_path")).alias("chapter_file"),
        F.coalesce(F.nullif(F.col("block.title"), F.lit("")), title_from_path(F.coalesce(F.col("block.file"), F.col("file_path")))).alias("title"),
    )


def chapter_title(custom: Column, toc: Column, document: Column, path: Column) -> Column:
    """The first that isn't empty: custom, contents, document, file name."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (custom, toc, document)), title_from_path(path))


def starts_ms(chapters: DataFrame, opening_ms: int = 0) -> DataFrame:
    """Chapters with their start: the durations before them, in whole milliseconds."""
    before = Window.partitionBy("book_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return chapters.withColumn("start_ms", (F.coalesce(F.sum("duration_ms").over(before), F.lit(0)) + opening_ms).cast("long"))


def problems(chapters: DataFrame) -> DataFrame:
    """(book_id, position, problem): what is wrong with ``chapters(book_id, position, title, start, duration)``.

    ``duration`` is the book's, or null.
    """
    w = Window.partitionBy("book_id").orderBy("position")
    before = F.lag("start").over(w)
    timed = F.max(F.col("start").isNotNull()).over(Window.partitionBy("book_id"))
    marked = chapters.withColumn("before", before).withColumn("timed", timed)
    found = F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit("empty title")),
        F.when(F.col("timed") & F.col("start").isNull(), F.lit("missing start")),
        F.when(F.col("start") < 0, F.lit("negative start")),
        F.when(F.col("start") <= F.col("before"), F.lit("not after the previous chapter")),
        F.when(F.col("start") > F.col("duration"), F.lit("beyond the end")),
    )
    return marked.select("book_id", "position", F.explode(F.array_compact(found)).alias("problem"))


def bodies(segments: DataFrame, chapter_of: DataFrame, text: str = "source_content") -> DataFrame:
    """(book_id, chapter_file, n_segments, body): a chapter's texts in reading order.

    A chapter's segments meet in one row; a book's chapter bounds it.
    """
    joined = segments.join(chapter_of.select("book_id", "file_path", "chapter_file"), ["book_id", "file_path"])
    parts = F.sort_array(F.collect_list(F.struct("spine_index", "order_in_file", text)))
    body = F.array_join(F.transform(parts, lambda x: x[text]), "\n\n")
    return joined.groupBy("book_id", "chapter_file").agg(F.count("*").alias("n_segments"), body.alias("body"), F.min("spine_index").alias("spine_index"))


def cache_valid(chapters: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, chapter_file, current): whether a built chapter has the same segments in the same order
    and none of its sources is newer; ``chapters`` and ``manifest`` hold (ids, newest) and (ids, built)."""
    both = chapters.join(manifest.withColumnRenamed("ids", "built_ids"), ["book_id", "chapter_file"], "left")
    return both.select("book_id", "chapter_file", F.coalesce((F.col("ids") == F.col("built_ids")) & (F.col("newest") <= F.col("built")), F.lit(False)).alias("current"))
