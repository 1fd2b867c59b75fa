"""Commands over a work folder: ``python -m quire.cli [--work WORK] [--config FILE] [-v|-q] COMMAND ...``.

A work folder holds tables: members, package, documents, segments, skips, answers, and the state as a log of commits (``sources.commits``).
It is reached through Spark's file systems only, so any store that Spark reads and writes will do. Settings come in layers
(``files.setting_layers``), and what a command is told by its arguments counts before them.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import audio, chapters, export as ex, models, reports, segments as sg, skip, sound, state as st, web
from quire.sources import epub, files, sinks
from quire.sources.commits import CommitLog

log = logging.getLogger("quire")


# The work folder


def state_log(spark: SparkSession, work: str) -> CommitLog:
    return CommitLog(spark, f"{work}/state")


def current(spark: SparkSession, work: str) -> int | None:
    """The version of the state that counts."""
    return state_log(spark, work).version()


def load(spark: SparkSession, work: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(state_log(spark, work).table() if n == "state" else spark.read.parquet(f"{work}/{n}") for n in names)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def tables(package: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine, toc) of packages."""
    spine = package.select("book_id", F.explode("spine").alias("s")).select("book_id", "s.file_path", "s.spine_index")
    toc = package.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.pos", "t.title", "t.href").where("href <> '' and title <> ''")
    return spine, toc


# Commands


def extract(spark: SparkSession, books: str, work: str, settings: dict | None = None) -> None:
    """E-books to tables: members, packages, segments with skip reasons, skips, and a pending state.

    A work folder that was made from other books is refused; records of segments that are still there stay.
    """
    own = {**files.DEFAULTS, **(settings or {})}
    source = f"{work}/source"
    if there(spark, source):
        files.checked_workspace(work, books, spark.read.json(source).first()["books"])
    found = epub.members(spark, books)
    found.write.mode("overwrite").parquet(f"{work}/members")
    found = spark.read.parquet(f"{work}/members")
    epub.packages(found).write.mode("overwrite").parquet(f"{work}/package")
    package = spark.read.parquet(f"{work}/package")
    epub.spine_documents(found, package).where("linear").write.mode("overwrite").parquet(f"{work}/documents")
    docs = spark.read.parquet(f"{work}/documents")
    spine, toc = tables(package)
    skips = skip.candidates(toc, spine, own["skip_after_back_matter"], own["skip_rules"], own["back_matter_triggers"], own["back_matter_threshold"])
    skips.write.mode("overwrite").parquet(f"{work}/skips")
    rows = skip.tagged(sg.unique_ids(sg.segment_documents(docs)), spark.read.parquet(f"{work}/skips"))
    rows.write.mode("overwrite").parquet(f"{work}/segments")
    spark.createDataFrame([(books,)], "books string").coalesce(1).write.mode("overwrite").json(source)
    rows = spark.read.parquet(f"{work}/segments")
    state_log(spark, work).commit(lambda old: st.ensured(rows, spark.createDataFrame([], files.STATE_SCHEMA) if old is None else old), "extract")


def listed(spark: SparkSession, names: list[str] | None, rows: DataFrame) -> DataFrame | None:
    """The files of all books that a setting lists, or None without a list."""
    if names is None:
        return None
    return rows.select("book_id", "file_path").where(F.col("file_path").isin(*names) if names else F.lit(False)).distinct()


def translate(spark: SparkSession, work: str, target: str | None = None, client: Callable = models.Stub, settings: dict | None = None) -> None:
    """Pending segments through a client; a new version of the state.

    Answers are committed window by window. A run that died is taken up: its folder is named by the version of the state that it
    started from. Records of other writers that came meanwhile stay.
    """
    own = {**files.DEFAULTS, **(settings or {})}
    target = target or own["target_language"]
    rows, state = load(spark, work, "segments", "state")
    todo = st.pending(st.chosen(rows, listed(spark, own["translation_files"], rows)), state)
    intro = own["prompt_preamble"] or models.INTRO
    step = lambda found: models.translate(found, client, own["source_language"], target, workers=int(own["translation_workers"]), intro=intro)
    done = models.in_windows(todo, f"{work}/answers-{current(spark, work)}", step, cooldown_s=own["cooldown_seconds"])
    version = state_log(spark, work).commit(lambda old: st.merged(old, done), f"translate into {target}")
    log.info("state %d: %d answers", version, done.count())


def export(spark: SparkSession, work: str, kind: str, out: str, mode: str | None = None, settings: dict | None = None) -> None:
    """All files of an export, or none if it fails. ``epub``: whole books. ``web``: a folder a book. ``web-zip``: that as one archive. ``markdown``: a file a chapter.
    ``combined``: a markdown file a book. ``images``: the books' images.
    """
    found, package, docs, rows, state = load(spark, work, "members", "package", "documents", "segments", "state")
    answers = st.injectable(rows, state)
    mode = files.output_mode(mode or (settings or files.DEFAULTS)["output_mode"])
    folder = files.folder_name(F.col("book_id"))
    if kind in ("markdown", "combined"):
        spine, toc = tables(package)
        named = chapters.audio_chapter_of(spine, toc)
        answers = ex.markdown_answers(answers, epub.images(package).select("book_id", "file_path", "name"))
        bodies = chapters.bodies(answers, named, "translation").join(named.select("book_id", "chapter_file", "title").distinct(), ["book_id", "chapter_file"])
        bodies = bodies.withColumn("position", F.col("spine_index"))
        if kind == "markdown":
            sinks.write_files(files.chapter_files(bodies), out)
        else:
            whole = files.combined_markdown(bodies)
            sinks.write_files(whole.select(F.concat(folder, F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content")), out)
        return
    if kind == "images":
        shown = epub.image_files(found, package)
        sinks.write_files(shown.select(F.concat(folder, F.lit("/"), "path").alias("path"), "content"), out)
        return
    gone = sg.missing_documents(docs, answers)
    if not gone.isEmpty():
        files.write_report(gone, f"{work}/missing-documents")
        log.warning("translations without a document: see %s/missing-documents", work)
    # What goes out is made before anything that is there is replaced.
    sg.inject(docs, answers, mode).select("book_id", "file_path", "html").write.mode("overwrite").parquet(f"{work}/pages-{mode}")
    pages = spark.read.parquet(f"{work}/pages-{mode}")
    if kind == "epub":
        only = mode == "translated_only"
        made = epub.book_members(found, pages, sg.headings(answers, docs) if only else None, only)
        ending = "_translated.epub" if only else "_bilingual.epub"
        sinks.write_archives(made.select(F.concat(folder, F.lit(ending)).alias("path"), "member", "content"), out)
        return
    if kind not in ("web", "web-zip"):
        raise ValueError(f"unknown kind of export: {kind}")
    spine, toc = tables(package)
    order = ex.web_spine(spine.join(docs.select("book_id", "file_path"), ["book_id", "file_path"]), chapters.titles_by_file(toc))
    books = ex.metadata(package).select("book_id", "title")
    entries = package.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")
    data = ex.book_json(books, order, ex.web_toc(entries)).join(books, "book_id")
    clean = sg.column_map(pages, web.cleaned, ["html", "file_path"], "html")
    parts = ex.web_files(found, clean, data)
    if kind == "web":
        sinks.write_files(parts.select(F.concat(folder, F.lit("/"), "path").alias("path"), "content"), out)
    else:
        sinks.write_archives(parts.select(F.concat(folder, F.lit(".zip")).alias("path"), F.col("path").alias("member"), "content"), out)


def pipeline(spark: SparkSession, books: str, work: str, out: str, target: str | None = None, settings: dict | None = None) -> None:
    """Extraction, translation, and both kinds of e-books and the web export."""
    extract(spark, books, work, settings)
    translate(spark, work, target, settings=settings)
    for mode in ("bilingual", "translated_only"):
        export(spark, work, "epub", out, mode)
    export(spark, work, "web", f"{out}/web", settings=settings)


def resume(spark: SparkSession, work: str) -> DataFrame:
    """Per book how many segments remain, are done, are skipped."""
    rows, state = load(spark, work, "segments", "state")
    return st.resume_counts(rows, state)


def format_(spark: SparkSession, work: str) -> None:
    """Uniform typography in completed Chinese translations; a new version of the state."""
    state_log(spark, work).commit(st.polished, "format")


def config_validate(spark: SparkSession | None, path: str) -> list[str]:
    """What is wrong with a settings file; nothing is an empty list."""
    found, unknown = files.settings([path])
    wrong = [f"unknown key: {k}" for k in unknown]
    return wrong + files.settings_problems(found)


def config_reset(spark: SparkSession | None, path: str, backup: bool = False) -> None:
    """The settings file with the defaults; the old one may be kept beside it."""
    if backup and os.path.exists(path):
        os.replace(path, path + ".bak")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {json.dumps(v)}\n" for k, v in files.DEFAULTS.items())


def config_template(spark: SparkSession, work: str, folder: str) -> int:
    """A settings file for each book, with its documents in order; those that are there stay. A book is a row at a time."""
    rows, skips = load(spark, work, "segments", "skips")
    listed = ex.template_files(rows, skips).groupBy("book_id").agg(F.collect_list(F.struct("file_path", "spine_index", "active")).alias("rows"))
    os.makedirs(folder, exist_ok=True)
    return sum(
        files.write_new(f"{folder}/{files.work_name(r['book_id'])}.yaml", files.settings_template([x.asDict() for x in r["rows"]])) for r in listed.toLocalIterator()
    )


def audiobook_generate(
    spark: SparkSession, work: str, voice: str | None = None, make: Callable = models.SilentSpeaker, settings: dict | None = None
) -> None:
    """What is to be spoken through a speaker; audio and the plan by which it is joined go to the work folder."""
    own = {**files.DEFAULTS, **(settings or {})}
    package, docs, rows, state = load(spark, work, "package", "documents", "segments", "state")
    wanted = listed(spark, own["audiobook_files"], rows)
    said = sg.spoken(rows if wanted is None else st.chosen(rows, wanted), docs)
    plan = st.audio_plan(said.withColumn("source_content", F.coalesce("from_source", F.lit(""))), state).where("skipped_because is null")
    render = models.render(plan, make, voice or own["audiobook_voice"] or "narrator", workers=int(own["audiobook_workers"]))
    render.write.mode("overwrite").parquet(f"{work}/audio")
    made = spark.read.parquet(f"{work}/audio").select("book_id", "segment_id", "status", F.concat("segment_id", F.lit(".wav")).alias("audio_path"), "duration_seconds")
    spine, toc = tables(package)
    audio.assembly(rows, chapters.audio_chapter_of(spine, toc), made).write.mode("overwrite").parquet(f"{work}/assembly")


def audiobook_assemble(spark: SparkSession, work: str, out: str, settings: dict | None = None) -> None:
    """The rendered sound as WAV files: one for each chapter, and one for each book with its tags and a mark at each chapter."""
    own = {**files.DEFAULTS, **(settings or {})}
    package, rows, made = load(spark, work, "package", "segments", "audio")
    spine, toc = tables(package)
    named = chapters.audio_chapter_of(spine, toc)
    first = named.groupBy("book_id", "chapter_file").agg(F.min("spine_index").alias("position"), F.min_by("title", "spine_index").alias("title"))
    plan = rows.select("book_id", "file_path", "segment_id", "spine_index", "order_in_file").join(named.select("book_id", "file_path", "chapter_file"), ["book_id", "file_path"])
    plan = sound.with_gaps(plan.join(first.drop("title"), ["book_id", "chapter_file"]))
    found = sound.parts(made)
    folder = files.folder_name(F.col("book_id"))
    narrator = own["audiobook_voice"] or "narrator"
    tags = audio.tags(ex.metadata(package), narrator)
    order = ["position", "spine_index", "order_in_file"]
    each = sound.laid_out(plan, found, ["book_id", "chapter_file"], order)
    name = F.concat(folder, F.lit("/"), files.slug(files.stem(F.col("chapter_file"))), F.lit("-"), F.substring(F.sha1("chapter_file"), 1, 8), F.lit(".wav"))
    sinks.write_joined(sound.pieces(each, found, ["book_id", "chapter_file"], name, tags, first), out)
    whole = sound.laid_out(plan, found, ["book_id"], order)
    sinks.write_joined(sound.pieces(whole, found, ["book_id"], F.concat(folder, F.lit(".wav")), tags, first), out)


def audiobook_export_chapters(spark: SparkSession, work: str, out: str) -> None:
    """A chapters file a book, with the starts that the plan gives; a book is a row at a time."""
    package, plan = load(spark, work, "package", "assembly")
    spine, toc = tables(package)
    named = chapters.audio_chapter_of(spine, toc).select("book_id", "chapter_file", "title").distinct()
    length = plan.groupBy("book_id", "chapter_file").agg(F.sum("ms").alias("duration_ms"), F.min(F.struct("segment_id")).alias("s"))
    order = chapters.audio_chapter_of(spine, toc).groupBy("book_id", "chapter_file").agg(F.min("spine_index").alias("position"))
    starts = chapters.starts_ms(length.join(order, ["book_id", "chapter_file"])).join(named, ["book_id", "chapter_file"])
    os.makedirs(out, exist_ok=True)
    listed = starts.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("position", "title", "start_ms"))).alias("chapters"))
    for r in listed.toLocalIterator():
        found = [{"title": c["title"], "start": c["start_ms"] / 1000} for c in r["chapters"]]
        files.write_chapters(f"{out}/{files.work_name(r['book_id'])}.yaml", found, {"book": r["book_id"]})


def audiobook_update_chapters(spark: SparkSession | None, book: str, chapters_file: str) -> None:
    """An audio book's container with the chapters of a file; it is replaced whole."""
    listed, _ = files.read_chapters(chapters_file)
    with open(book, "rb") as f:
        made = audio.with_chapters(f.read(), [(c["start"] or 0.0, c.get("title") or "") for c in listed])
    aside = f"{book}.{uuid.uuid4().hex}"
    with open(aside, "xb") as f:
        f.write(made)
    os.replace(aside, book)


def purge_refusals(spark: SparkSession, work: str, dry_run: bool = False) -> int:
    """Records whose answer declines become pending; how many those are."""
    state = load(spark, work, "state")[0]
    new = st.purged(state)
    n = state.join(new.where("status = 'pending'").select(*st.KEY), st.KEY, "left_semi").where("status <> 'pending'").count()
    if n and not dry_run:
        state_log(spark, work).commit(st.purged, "purge refusals")
    return n


def report(spark: SparkSession, work: str, name: str) -> DataFrame:
    rows, state, skips, package = load(spark, work, "segments", "state", "skips", "package")
    return {
        "files": lambda: reports.files(rows),
        "pending": lambda: reports.pending_by_file(rows, state),
        "progress": lambda: reports.progress(rows, state),
        "dashboard": lambda: reports.dashboard(state),
        "resume": lambda: st.resume_counts(rows, state),
        "skips": lambda: reports.skip_counts(skips),
        "skip-list": lambda: ex.skip_list(skips, state, rows),
        "skip-candidates": lambda: ex.skip_flags(rows, skips),
        "orphans": lambda: st.orphans(rows, state),
        "totals": lambda: reports.pending_totals(rows, state),
        "covers": lambda: covers(spark, work),
        "workspace": lambda: reports.library_totals(tables(package)[0], skips),
    }[name]()


def covers(spark: SparkSession, work: str) -> DataFrame:
    """The cover of each book: marked in its package, shown first, named so, or its first image."""
    package, docs = load(spark, work, "package", "documents")
    items = package.select("book_id", F.posexplode("manifest").alias("pos", "m")).select("book_id", "pos", "m.file_path", "m.id", "m.media_type")
    images = items.where(F.col("media_type").startswith("image/"))
    marked = images.where(F.lower("id").contains("cover")).select("book_id", "file_path")
    return ex.covers(images.select("book_id", "pos", "file_path"), marked, sg.image_references(docs))


def audiobook_read_chapters(spark: SparkSession | None, book: str, out: str) -> None:
    """A chapters file from an audio book's container."""
    with open(book, "rb") as f:
        found, length = audio.read_mp4(f.read())
    files.write_chapters(out, [{"title": t, "start": s} for s, t in found], {"source": book, "duration": round(length, 3)})


def analyze_skips(spark: SparkSession, work: str, out: str) -> None:
    """The report on skips as JSON."""
    files.write_report(report(spark, work, "skips"), out)


def inspect_segment(spark: SparkSession, work: str, segment: str) -> DataFrame:
    rows, state = load(spark, work, "segments", "state")
    return ex.lookup(rows, state, segment)


#: Command, its function, its arguments; ``work`` comes from the global option.
COMMANDS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "extract": (extract, ("books",)),
    "translate": (translate, ("--target",)),
    "export": (export, ("kind", "out", "--mode")),
    "pipeline": (pipeline, ("books", "out", "--target")),
    "resume": (resume, ()),
    "format": (format_, ()),
    "config-validate": (config_validate, ("path",)),
    "config-reset": (config_reset, ("path", "--backup")),
    "config-template": (config_template, ("folder",)),
    "audiobook-generate": (audiobook_generate, ("--voice",)),
    "audiobook-assemble": (audiobook_assemble, ("out",)),
    "audiobook-export-chapters": (audiobook_export_chapters, ("out",)),
    "audiobook-read-chapters": (audiobook_read_chapters, ("book", "out")),
    "audiobook-update-chapters": (audiobook_update_chapters, ("book", "chapters_file")),
    "debug-show-skip-list": (lambda spark, work: report(spark, work, "skip-list"), ()),
    "debug-show-pending": (lambda spark, work: report(spark, work, "pending"), ()),
    "debug-purge-refusals": (purge_refusals, ("--dry-run",)),
    "debug-inspect-segment": (inspect_segment, ("segment",)),
    "debug-list-files": (lambda spark, work: report(spark, work, "files"), ()),
    "debug-preview-skip-candidates": (lambda spark, work: report(spark, work, "skip-candidates"), ()),
    "debug-workspace": (lambda spark, work: report(spark, work, "workspace"), ()),
    "debug-analyze-skips": (analyze_skips, ("out",)),
    "report": (report, ("name",)),
}
_FLAGS = ("--backup", "--dry-run")
_LOCAL = ("config-validate", "config-reset", "audiobook-read-chapters", "audiobook-update-chapters")
#: Commands that take settings.
_SET = ("extract", "translate", "export", "pipeline", "audiobook-generate", "audiobook-assemble")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire")
    parser.add_argument("--work")
    parser.add_argument("--config", help="a settings file that counts before all other layers")
    loud = parser.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, names) in COMMANDS.items():
        sub = commands.add_parser(name)
        for n in names:
            sub.add_argument(n, **({"action": "store_true"} if n in _FLAGS else {}))
    args = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    logging.basicConfig(format="%(message)s")
    log.setLevel(logging.DEBUG if args.pop("verbose") else logging.ERROR if args.pop("quiet") else logging.INFO)
    args.pop("quiet", None)
    command, config = args.pop("command"), args.pop("config", None)
    settings, unknown = files.settings(files.setting_layers(config))
    for key in unknown:
        log.warning("unknown setting: %s", key)
    work = args.pop("work", settings["work_dir"])
    if command in _SET:
        problems = files.settings_problems(settings)
        if problems:
            parser.error("; ".join(problems))
        args["settings"] = settings
    if command in _LOCAL:
        result = COMMANDS[command][0](None, **args)
    else:
        result = COMMANDS[command][0](SparkSession.builder.appName("quire").getOrCreate(), work=work, **args)
    if isinstance(result, DataFrame):
        result.show(100, truncate=False)
    elif result is not None:
        print(result)


if __name__ == "__main__":
    main()
