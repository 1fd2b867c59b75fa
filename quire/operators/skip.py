"""Which documents of a book are skipped: table-of-contents keywords, and what follows back matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.paths import file_of
from quire.functions.text import collapse, keyword_match

# Keywords in the order in which they are tried.
KEYWORDS = (
    "cover", "praise", "also by", "copyright", "dedication", "acknowledgment", "acknowledgement", "the author", "further reading",
    "photograph", "credit", "glossary", "bibliography", "notes", "endnote", "endnotes", "index", "appendix", "appendices", "afterword",
    "reference", "references",
)
TRIGGERS = ("index", "notes", "endnotes", "bibliography", "references", "glossary")
THRESHOLD, FRONT, BACK = 0.7, 8, 6


def entries(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Entries of ``toc(book_id, pos, title, href)`` on the spine, with each book's number of entries."""
    counted = toc.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).withColumn("file_path", file_of(F.col("href")))
    return counted.join(spine.select("book_id", "file_path", "spine_index"), ["book_id", "file_path"])


def by_title(found: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """(book_id, file_path, spine_index, reason, source): files whose last matching title names a keyword."""
    hits = found.withColumn("reason", keyword_match(F.col("title"), keywords)).where("reason is not null")
    return hits.groupBy("book_id", "file_path", "spine_index").agg(F.max_by("reason", "pos").alias("reason")).withColumn("source", F.lit("toc"))


def after_back_matter(found: DataFrame, spine: DataFrame, titled: DataFrame, triggers=TRIGGERS, threshold: float = THRESHOLD) -> DataFrame:
    """Files behind the earliest trigger in the last part of a book's contents."""
    word = keyword_match(F.col("title"), triggers)
    late = found.withColumn("word", word).where((F.col("pos") >= F.floor(F.col("n") * threshold)) & F.col("word").isNotNull())
    first = late.groupBy("book_id").agg(F.min_by(F.struct(F.col("spine_index").alias("at"), "word"), "pos").alias("t"))
    # One row a book meets the spine on the book's id; the range is a filter on that.
    behind = spine.select("book_id", "file_path", "spine_index").join(first, "book_id").where("spine_index > t.at")
    behind = behind.join(titled, ["book_id", "file_path"], "left_anti")
    return behind.select("book_id", "file_path", "spine_index", F.concat(F.lit("after "), F.col("t.word")).alias("reason"), F.lit("cascade").alias("source"))


def candidates(
    toc: DataFrame, spine: DataFrame, cascade: bool = True, keywords=KEYWORDS, triggers=TRIGGERS, threshold: float = THRESHOLD
) -> DataFrame:
    found = entries(toc, spine)
    titled = by_title(found, keywords)
    return titled.unionByName(after_back_matter(found, spine, titled, triggers, threshold)) if cascade else titled


def unmatched_titles(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Titles at a book's front and back that no keyword names and that don't look like chapters."""
    found = entries(toc, spine).withColumn("norm", F.lower(collapse(F.col("title"))))
    edge = (F.col("pos") < FRONT) | (F.col("pos") >= F.greatest(F.col("n") - BACK, F.lit(0)))
    plain = ~F.col("norm").rlike(r"(?U)\d") & ~F.col("norm").contains("chapter") & ~F.col("norm").contains("part") & (F.col("norm") != "")
    fits = found.where(edge & plain & keyword_match(F.col("title"), KEYWORDS).isNull())
    return fits.groupBy("book_id", "norm").agg(F.min("pos").alias("pos"))


def tagged(segments: DataFrame, skips: DataFrame) -> DataFrame:
    """Segments with why their file is skipped, if it is."""
    named = skips.select("book_id", "file_path", F.col("reason").alias("skip_reason"), F.col("source").alias("skip_source"))
    return segments.join(named, ["book_id", "file_path"], "left")
