"""What an export needs: covers, titles, lists of documents, archives' key files, and reports on skips."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.paths import content_path, file_of, fragment_of
from quire.functions.text import script_safe, stem
from quire.operators import web
from quire.operators.numbering import numbered
from quire.operators.segments import column_map


def year(date: Column) -> Column:
    """The year of a publication date, or the date as it is."""
    return F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4)).otherwise(date)


def metadata(package: DataFrame) -> DataFrame:
    """(book_id, title, creator, publisher, year): the first value of each."""
    return first_values(package.select("book_id", F.posexplode("metadata").alias("pos", "m")).select("book_id", "pos", "m.key", "m.value"))


def first_values(rows: DataFrame) -> DataFrame:
    """The same of ``rows(book_id, pos, key, value)``; no book is brought together."""
    first = lambda k: F.min_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("pos")))
    return rows.groupBy("book_id").agg(first("title").alias("title"), first("creator").alias("creator"), first("publisher").alias("publisher"), year(first("date")).alias("year"))


def key_files(members: DataFrame) -> DataFrame:
    """(book_id, kind, member): mimetype, container, package and contents; the shallowest, then the first by name."""
    low = F.lower(F.col("member"))
    kind = (
        F.when(low.rlike("(^|/)mimetype$"), "mimetype").when(low.endswith("container.xml"), "container").when(low.endswith(".opf"), "opf").when(low.endswith(".ncx"), "ncx")
    )
    depth = F.length("member") - F.length(F.replace(F.col("member"), F.lit("/"), F.lit("")))
    return members.withColumn("kind", kind).where("kind is not null").groupBy("book_id", "kind").agg(F.min_by("member", F.struct(depth, low)).alias("member"))


def covers(images: DataFrame, marked: DataFrame, referenced: DataFrame) -> DataFrame:
    """(book_id, cover): the marked image, the first referenced in reading order, one named cover, the first.

    ``marked(book_id, file_path)``; ``referenced(book_id, spine_index, pos, file_path)``;
    ``images(book_id, pos, file_path)``.
    """
    there = ["book_id", "file_path"]
    a = marked.join(images.select(*there), there, "left_semi").groupBy("book_id").agg(F.min("file_path").alias("a"))
    b = referenced.join(images.select(*there), there, "left_semi").groupBy("book_id").agg(F.min_by("file_path", F.struct("spine_index", "pos")).alias("b"))
    named = F.when(F.lower("file_path").contains("cover"), F.col("pos"))
    c = images.groupBy("book_id").agg(F.min_by("file_path", named).alias("c"), F.min_by("file_path", "pos").alias("d"), F.min(named).alias("has"))
    found = c.join(a, "book_id", "left").join(b, "book_id", "left")
    return found.select("book_id", F.coalesce("a", "b", F.when(F.col("has").isNotNull(), F.col("c")), "d").alias("cover"))


def image_names(images: DataFrame) -> DataFrame:
    """(book_id, file_path, name): a name that occurs again in a book gets its number."""
    rows = numbered(images.withColumn("base", F.substring_index("file_path", "/", -1)), ["book_id", "base"], "pos")
    dot = F.instr(F.reverse("base"), ".")
    head, tail = F.when(dot > 0, F.expr("substring(base, 1, length(base) - instr(reverse(base), '.'))")).otherwise(F.col("base")), F.when(dot > 0, F.expr("right(base, instr(reverse(base), '.'))")).otherwise("")
    return rows.select("book_id", "file_path", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat(head, F.lit("_"), "nth", tail)).alias("name"))


def web_spine(spine: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, spine_index, href, title): the exported documents with a title or their file's name."""
    joined = spine.join(titles.select("book_id", "file_path", "title"), ["book_id", "file_path"], "left")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem(F.col("file_path")))
    return joined.select("book_id", "spine_index", content_path(F.lit(""), F.col("file_path")).alias("href"), title.alias("title"))


def web_toc(toc: DataFrame) -> DataFrame:
    """(book_id, pos, level, title, href): the entries that lead somewhere, with their depth; mere sections fall away."""
    return toc.where("href <> ''").select("book_id", "pos", "level", "title", content_path(F.lit(""), F.col("href")).alias("href"))


def book_json(books: DataFrame, spine: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, json): a book's data for a script element; a book's spine and contents bound a row."""
    docs = spine.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("spine_index", "href", "title"))).alias("spine"))
    entries = toc.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in ("level", "title", "href") if c in toc.columns)))).alias("toc"))
    joined = books.join(docs, "book_id", "left").join(entries, "book_id", "left")
    return joined.select("book_id", script_safe(F.to_json(F.struct("title", "spine", "toc"))).alias("json"))


def toc_titles(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """Entries with translated titles: the heading at the fragment, the file's heading, else the old title.

    ``headings(book_id, file_path, fragment, title)``; a null fragment stands for the file.
    """
    rows = toc.withColumns({"file_path": file_of(F.col("href")), "fragment": fragment_of(F.col("href"))})
    at = headings.where("fragment is not null").withColumnRenamed("title", "by_fragment")
    whole = headings.where("fragment is null").select("book_id", "file_path", F.col("title").alias("by_file"))
    rows = rows.join(at, ["book_id", "file_path", "fragment"], "left").join(whole, ["book_id", "file_path"], "left")
    return rows.select("book_id", "pos", "href", F.coalesce("by_fragment", "by_file", "title").alias("title"))


def preview(chapter_of: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, chapter_file, title, files, n_segments) of each chapter, in order of its first document."""
    joined = segments.join(chapter_of.select("book_id", "file_path", "chapter_file", "title"), ["book_id", "file_path"])
    # A row a file first: the list is of a chapter's files, not of its segments.
    by_file = joined.groupBy("book_id", "chapter_file", "title", "spine_index", "file_path").agg(F.count("*").alias("n"))
    files = F.transform(F.sort_array(F.collect_list(F.struct("spine_index", "file_path"))), lambda x: x["file_path"])
    return by_file.groupBy("book_id", "chapter_file", "title").agg(files.alias("files"), F.sum("n").alias("n_segments"), F.min("spine_index").alias("spine_index"))


def skip_list(skips: DataFrame, state: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, kind, name, reason): skipped documents, and skipped segments with what was noted."""
    docs = skips.select("book_id", F.lit("document").alias("kind"), F.col("file_path").alias("name"), "reason")
    known = state.where("status = 'skipped'").join(segments.select("book_id", "segment_id", "file_path"), ["book_id", "segment_id"])
    return docs.union(known.select("book_id", F.lit("segment"), "segment_id", F.coalesce("error_message", F.lit(""))))


def lookup(segments: DataFrame, state: DataFrame, segment_id: str | DataFrame) -> DataFrame:
    """A segment and its record, or those of all ids of a table; the filter reaches both sides."""
    if isinstance(segment_id, DataFrame):
        return segments.join(segment_id, "segment_id", "left_semi").join(state, ["book_id", "segment_id"], "left")
    return segments.where(F.col("segment_id") == segment_id).join(state.where(F.col("segment_id") == segment_id), ["book_id", "segment_id"], "left")


def template_files(segments: DataFrame, skips: DataFrame) -> DataFrame:
    """(book_id, file_path, spine_index, active): the files of a book's settings; skipped-only ones come last."""
    active = segments.groupBy("book_id", "file_path").agg(F.min("spine_index").alias("spine_index"))
    both = active.join(skips.select("book_id", "file_path", "reason"), ["book_id", "file_path"], "full")
    return both.select("book_id", "file_path", F.coalesce("spine_index", F.lit(9999)).alias("spine_index"), F.col("reason").isNull().alias("active"))


def same_artifact(segments: DataFrame, state: DataFrame) -> bool:
    """Whether two saved tables belong together: they share an id."""
    return not segments.join(state, ["book_id", "segment_id"], "left_semi").limit(1).isEmpty()


def markdown_answers(answers: DataFrame, images: DataFrame) -> DataFrame:
    """``answers`` with what markdown shows of each translation: markup converted, its images by the names they are exported under.

    ``images(book_id, file_path, name)``; a book's images bound a row.
    """
    named = images.groupBy("book_id").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("file_path", "name")))).alias("names"))
    rows = answers.join(named, "book_id", "left").withColumn("names", F.coalesce("names", F.lit("{}")))
    shown = column_map(rows, lambda text, path, names: web.markdown(text, path, json.loads(names)), ["translation", "file_path", "names"], "shown")
    return shown.withColumn("translation", F.when(F.col("extract_mode") == "html", F.col("shown")).otherwise(F.col("translation"))).drop("shown", "names")


#: Members that a web export leaves out: what only readers of e-books use.
_PACKAGING = r"(?i)(^mimetype$|^META-INF/|\.opf$|\.ncx$|\.x?html?$)"


def web_files(members: DataFrame, pages: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, path, content): a start page, the documents and the static files of each book's web export.

    ``members(book_id, member, content)``, ``pages(book_id, file_path, html)``, already cleaned, ``books(book_id, title, json)``.
    """
    index = books.select("book_id", F.lit("index.html").alias("path"), F.encode(web.start_page(F.coalesce("title", F.lit("")), F.col("json")), "UTF-8").alias("content"))
    docs = pages.select("book_id", F.concat(F.lit("content/"), "file_path"), F.encode("html", "UTF-8"))
    static = members.where(~F.col("member").rlike(_PACKAGING)).select("book_id", F.concat(F.lit("content/"), "member"), "content")
    return index.union(docs).union(static)


def skip_flags(segments: DataFrame, skips: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """(book_id, file_path, spine_index, reason, source, flagged): files that rules name, in reading order.

    ``override(book_id, file_path, flagged)`` is what a reader decided instead.
    """
    files = segments.groupBy("book_id", "file_path").agg(F.min("spine_index").alias("spine_index"))
    named = skips.select("book_id", "file_path", "reason", "source").join(files, ["book_id", "file_path"], "left")
    if override is not None:
        named = named.join(override.select("book_id", "file_path", F.col("flagged").alias("chosen")), ["book_id", "file_path"], "left")
    flagged = F.lit(True) if override is None else F.coalesce("chosen", F.lit(True))
    found = named.select("book_id", "file_path", "spine_index", "reason", "source", flagged.alias("flagged"))
    return found.orderBy("book_id", F.col("spine_index").asc_nulls_last(), "file_path")
