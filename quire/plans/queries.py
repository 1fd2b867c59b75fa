"""Queries over the standard tables, one for each operator, each with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions import paths, text
from quire.operators import abbreviations, audio, chapters, export, models, reports, segments, skip, state as st, web
from quire.sources import library as lib
from quire.operators.numbering import numbered
from quire.sources.library import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans and filters over the spine


@query("SELECT book_id, file_path, spine_index FROM spine WHERE linear", "spine")
def spine_linear(spark, sf):
    """Spine items of the reading order; gaps stay where others were."""
    return lib.spine(spark, sf).where("linear").select("book_id", "file_path", "spine_index")


@query(
    """SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS BIGINT) AS nth FROM (
 SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)"""
)
def library_scan(spark, sf):
    """Pages as members of the book of their host, numbered in blocks of ids; a page over the size limit fails the scan."""
    large = F.raise_error(F.concat(F.lit("larger than 500 MiB: page "), F.col("page_id").cast("string"))).cast("long")
    checked = F.when(F.octet_length("html") > 500 * 1024 * 1024, large).otherwise(F.col("page_id"))
    rows = table(spark, sf, "pages").select(checked.alias("page_id"), F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"))
    return numbered(rows, ["host"], "page_id").select("page_id", "host", F.col("nth").cast("long").alias("nth"))


@query(
    """SELECT book_id, count(*) AS n_docs, min(substr(file_path, 6)) AS first_name, CAST(sum(CASE WHEN linear THEN 1 ELSE 0 END) AS BIGINT) AS n_linear
 FROM spine GROUP BY book_id""",
    "spine",
)
def spine_scan(spark, sf):
    rows = lib.spine(spark, sf)
    return rows.groupBy("book_id").agg(
        F.count("*").alias("n_docs"), F.min(F.expr("substring(file_path, 6)")).alias("first_name"), F.count_if("linear").alias("n_linear")
    )


@query(
    """SELECT host, name, nth, CASE WHEN nth = 1 THEN name ELSE regexp_extract(name, '^([^.]*)', 1) || '-' || nth || regexp_extract(name, '^[^.]*(.*)$', 1) END AS flat FROM (
 SELECT host, name, CAST(row_number() OVER (PARTITION BY host, name ORDER BY page_id) AS BIGINT) AS nth FROM (
 SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^/([^/]*)', 1) || '.html' AS name FROM pages))"""
)
def archive_names(spark, sf):
    """Members in one flat folder: names that occur again get numbers."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    name = F.concat(F.regexp_extract(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), r"^/([^/]*)", 1), F.lit(".html"))
    rows = table(spark, sf, "pages").select("page_id", host.alias("host"), name.alias("name"))
    rows = numbered(rows, ["host", "name"], "page_id").withColumn("nth", F.col("nth").cast("long"))
    return rows.select("host", "name", "nth", paths.numbered_names(F.col("name"), F.col("nth")).alias("flat"))


# Segments and scalar functions


@query("SELECT book_id, segment_id, file_path, order_in_file, element_type, source_content FROM segments", "segments")
def segments_text(spark, sf):
    return lib.segments(spark, sf).select("book_id", "segment_id", "file_path", "order_in_file", "element_type", "source_content")


COPY = """CASE WHEN t = '' THEN 'empty'
 WHEN regexp_full_match(t, '[\\s…—–―·•*&^%$#@!~`´°¤§±×÷⇒→←↑↓│¦∗⊗∘\\[\\]{}()<>\\\\/|-]+') THEN 'punctuation'
 WHEN regexp_full_match(t, '[\\s\\d.,:;()\\-–—〜~]+') THEN 'number'
 WHEN regexp_full_match(t, '(?i)(page|p\\.?|pp\\.?)[\\s\\divxlc]+') THEN 'page'
 WHEN regexp_full_match(t, '(?i)isbn[\\s:\\-–—]*[\\d\\-–—\\sx]{8,}') THEN 'isbn'
 WHEN length(t) <= 3 AND NOT regexp_matches(t, '\\p{L}') THEN 'short' ELSE 'translate' END"""


@query(
    f"""SELECT lang, class, count(*) AS n FROM (SELECT lang, {COPY} AS class FROM (
 SELECT lang, trim(unnest(string_split_regex(text, '[ \\n]')), ' ') AS t FROM documents)) GROUP BY lang, class"""
)
def copy_classes(spark, sf):
    """Why pieces of text need no model, counted by language; every word is a piece."""
    words = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "[ \n]")).alias("t"))
    distinct = words.groupBy("lang", "t").agg(F.count("*").alias("n"))  # each word is classified once
    return distinct.groupBy("lang", text.copy_class(F.col("t")).alias("class")).agg(F.sum("n").alias("n"))


REFUSE = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"


@query(
    """SELECT role, refused, count(*) AS n FROM (SELECT role, (""" + " OR ".join(f"starts_with(h, '{x.replace(chr(39), chr(39) * 2)}')" for x in text.REFUSALS)
    + " OR ((" + " OR ".join(f"starts_with(h, '{x.replace(chr(39), chr(39) * 2)}')" for x in text.APOLOGIES)
    + ") AND (" + " OR ".join(f"contains(h, '{x.replace(chr(39), chr(39) * 2)}')" for x in text.DECLINING)
    + """))) AS refused FROM (SELECT role, substr(replace(replace(lower(regexp_replace(trim(t, ' '), '\\s+', ' ', 'g')), '’', ''''), '`', ''''), 1, 400) AS h FROM (
 SELECT role, coalesce(CASE turn % 5 WHEN 0 THEN 'I’m  sorry, but I WON''T do that. ' || text WHEN 1 THEN 'I''m sorry for your loss. Yes.' WHEN 2 THEN ' As an AI ' || text ELSE text END, '') AS t FROM conversations)))
 GROUP BY role, refused"""
)
def refusals(spark, sf):
    """Answers that decline, by role; every turn gets an opening by its number so that each branch occurs."""
    turn = F.col("turn") % 5
    said = (
        F.when(turn == 0, F.concat(F.lit("I’m  sorry, but I WON'T do that. "), F.col("text")))
        .when(turn == 1, F.lit("I'm sorry for your loss. Yes."))
        .when(turn == 2, F.concat(F.lit(" As an AI "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "conversations").groupBy("role", text.refused(said).alias("refused")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, slug, CASE WHEN length(a) = 0 THEN 'audiobook' ELSE a END AS ascii_slug FROM (SELECT doc_id,
 CASE WHEN length(s) > 50 THEN rtrim(substr(s, 1, 50), '-') WHEN s = '' THEN 'untitled' ELSE s END AS slug, a FROM (
 SELECT doc_id, trim(lower(regexp_replace(trim(regexp_replace(t, '[<>:"/\\\\|?*!]', '', 'g')), '\\s+', '-', 'g')), '-') AS s,
 regexp_replace(regexp_replace(trim(t), '\\s+', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g') AS a FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)))"""
)
def slugs(spark, sf):
    """File names from whole texts."""
    title = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", text.slug(title).alias("slug"), text.ascii_slug(title).alias("ascii_slug"))


@query()
def text_slugs(spark, sf):
    return slugs(spark, sf)


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 86400 AS DOUBLE) + 0.5 * (o_orderkey % 2) AS secs,
 printf('%d:%02d:%02d', (o_orderkey % 86400) // 3600, (o_orderkey % 3600) // 60, o_orderkey % 60) || CASE WHEN o_orderkey % 2 = 1 THEN '.500' ELSE '' END AS stamp FROM orders"""
)
def stamps(spark, sf):
    """Seconds to time stamps and back."""
    value = F.col("o_orderkey") % 86400 + 0.5 * (F.col("o_orderkey") % 2)
    made = text.stamp(value)
    return table(spark, sf, "orders").select("o_orderkey", text.seconds(made).alias("secs"), made.alias("stamp"))


#: What the numerals of the query are read as, by hand; MM is not read.
ROMAN = "('I', 'One'), ('IV', 'Four'), ('XXI', 'Twenty-one'), ('XC', 'Ninety'), ('L', 'Fifty'), ('XLIX', 'Forty-nine')"


@query(
    f"""SELECT l.o_orderkey, CASE WHEN l.el IN ('h1', 'h2') OR l.n = 1 THEN CASE l.p WHEN '' THEN '' ELSE l.p || ' ' END || coalesce(r.w, l.num) || l.s ELSE l.t END AS spoken FROM (
 SELECT *, CASE p WHEN '' THEN '' ELSE p || ' ' END || num || s AS t FROM (SELECT o_orderkey, o_orderkey % 4 AS n, CASE o_orderkey % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' ELSE 'p' END AS el,
 CASE o_orderkey % 5 WHEN 0 THEN 'Chapter' WHEN 1 THEN 'Part' ELSE '' END AS p, (['I', 'IV', 'XXI', 'XC', 'MM', 'L', 'XLIX'])[CAST(o_orderkey % 7 AS INT) + 1] AS num,
 CASE o_orderkey % 2 WHEN 0 THEN '.' ELSE '' END AS s FROM orders)) l LEFT JOIN (VALUES {ROMAN}) r(num, w) ON l.num = r.num"""
)
def roman_words(spark, sf):
    key = F.col("o_orderkey")
    numeral = F.element_at(F.array(*map(F.lit, ("I", "IV", "XXI", "XC", "MM", "L", "XLIX"))), (key % 7 + 1).cast("int"))
    prefix = F.when(key % 5 == 0, "Chapter ").when(key % 5 == 1, "Part ").otherwise("")
    value = F.concat(prefix, numeral, F.when(key % 2 == 0, ".").otherwise(""))
    kind = F.when(key % 3 == 0, "h1").when(key % 3 == 1, "h2").otherwise("p")
    return table(spark, sf, "orders").select("o_orderkey", text.spoken_roman(value, kind, key % 4).alias("spoken"))


HREFS = ("../img/a.png", "b.xhtml#x", "/c/d.css", "data:image/png;base64,x", "mailto:a@b", "../../../out", "./e/../f.xhtml", "http://x.org/", "", "//h/x", "../.", "JavaScript:x")
#: A path without dots: parts fall off, then each part before a .. with it, as often as a path here can need it.
_DOTLESS = r"regexp_replace(regexp_replace(regexp_replace({0}, '^(\./)+', ''), '/(\./)+', '/', 'g'), '/\.$', '')"
_UP = r"regexp_replace({0}, '(^|/)[^/.]+/\.\.(/|$)', '\1')"
_FOLDED = _UP.format(_UP.format(_UP.format(_DOTLESS)))
_PATH_SQL = f"CASE WHEN rtrim({_FOLDED}, '/') = '' THEN '.' ELSE rtrim({_FOLDED}, '/') END"


@query(
    f"""SELECT doc_id, CASE WHEN href <> '' AND NOT regexp_matches(lower(href), '^(data:|mailto:|tel:|blob:|javascript:|//)') AND NOT contains(href, '://') AND NOT starts_with(inside, '../') THEN inside END AS resolved,
 CASE WHEN href = '' OR regexp_matches(lower(href), '^(data:|http:|https:|//|#|mailto:|tel:|ftp:|file:|blob:)') THEN href ELSE 'content/' || shown END AS content FROM (
 SELECT doc_id, href, {_PATH_SQL.format("q")} AS inside, {_PATH_SQL.format("p")} AS shown FROM (
 SELECT doc_id, href, 'text/d' || doc_id % 7 || '/' || href AS whole, regexp_replace('text/d' || doc_id % 7 || '/' || href, '/+', '/', 'g') AS p,
 CASE WHEN starts_with(href, '/') THEN ltrim(href, '/') ELSE 'text/d' || doc_id % 7 || '/' || href END AS q FROM (
 SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (['{"', '".join(HREFS)}'])[CAST(doc_id % {len(HREFS)} AS INT) + 1] ELSE '../d' || doc_id % 5 || '/./x' || doc_id || '.png' END AS href FROM documents)))"""
)
def hrefs(spark, sf):
    """Relative links resolved against the document they stand in, and rewritten for the web."""
    made = F.concat(F.lit("../d"), F.col("doc_id") % 5, F.lit("/./x"), "doc_id", F.lit(".png"))
    fixed = F.element_at(F.array(*map(F.lit, HREFS)), (F.col("doc_id") % len(HREFS) + 1).cast("int"))
    href = F.when(F.col("doc_id") % 2 == 0, fixed).otherwise(made)
    at = F.concat(F.lit("text/d"), F.col("doc_id") % 7, F.lit("/ch1.xhtml"))
    return table(spark, sf, "documents").select("doc_id", paths.resolved(at, href).alias("resolved"), paths.content_path(at, href).alias("content"))


@query(
    """SELECT page_id, regexp_matches(u, '^(javascript:|vbscript:|data:text/html)') AS dangerous, regexp_matches(lower(trim(u)), '^(data:|http:|https:|//|#|mailto:|tel:|ftp:|file:|blob:)') AS external FROM (
 SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'javascript:x' ELSE 'a/' || url END AS u FROM pages)"""
)
def url_classes(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.lit("Java\tScript: x")).otherwise(F.concat(F.lit("a/"), F.col("url")))
    external = F.when(F.col("page_id") % 3 == 1, F.lit("javascript:x")).otherwise(url)
    return table(spark, sf, "pages").select("page_id", text.dangerous_url(url).alias("dangerous"), text.external_url(external).alias("external"))


ALIASES = ("EN", " english", "Zh_Hans", "TW", "zh-cn ", "Simplified Chinese", "cmn", "日本語", "中文", "deu", "", "detect", "ko")
#: What they stand for, by hand: code, name, code of the service, whether it is Chinese.
_LANGUAGE_SQL = """('EN', 'en', 'English', 'EN', false), (' english', 'en', 'English', 'EN', false), ('Zh_Hans', 'zh-CN', 'Simplified Chinese', 'ZH-HANS', true),
 ('TW', 'zh-TW', 'Traditional Chinese', 'ZH-HANT', true), ('zh-cn ', 'zh-CN', 'Simplified Chinese', 'ZH-HANS', true), ('Simplified Chinese', 'zh-CN', 'Simplified Chinese', 'ZH-HANS', true),
 ('cmn', 'cmn', 'cmn', NULL, true), ('日本語', '日本語', '日本語', NULL, true), ('中文', '中文', '中文', NULL, true), ('deu', 'deu', 'deu', NULL, false), ('', 'auto', 'Auto', NULL, false),
 ('detect', 'auto', 'Auto', NULL, false), ('ko', 'ko', 'Korean', 'KO', false), (' EN', 'en', 'English', 'EN', false), (' DE', 'de', 'German', 'DE', false), (' FR', 'fr', 'French', 'FR', false),
 (' ES', 'es', 'Spanish', 'ES', false)"""


@query(
    f"""SELECT alias, code, name, deepl, chinese, count(*) AS n FROM (
 SELECT CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) ELSE ([{", ".join(f"'{x}'" for x in ALIASES)}])[CAST(doc_id % {len(ALIASES)} AS INT) + 1] END AS alias FROM documents)
 LEFT JOIN (VALUES {_LANGUAGE_SQL}) AS l(alias, code, name, deepl, chinese) USING (alias) GROUP BY ALL"""
)
def languages(spark, sf):
    """Names that people give languages, as codes, names, codes of one service, and whether they are Chinese."""
    fixed = F.element_at(F.array(*map(F.lit, ALIASES)), (F.col("doc_id") % len(ALIASES) + 1).cast("int"))
    alias = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(fixed)
    rows = table(spark, sf, "documents").select(alias.alias("alias")).withColumn("code", text.language_code(F.col("alias")))
    code = F.col("code")
    rows = rows.withColumns({"name": text.language_name(code), "deepl": text.deepl_code(code), "chinese": text.chinese_target(code)})
    return rows.groupBy("alias", "code", "name", "deepl", "chinese").agg(F.count("*").alias("n"))


@query(
    """SELECT segment_id, CASE WHEN length(source_content) > 80 THEN substr(source_content, 1, 79) || '…' ELSE source_content END AS preview,
 'Detect the source language automatically and translate it into Simplified Chinese. Return a faithful translation of the prose without adding explanations.' || chr(10) || chr(10) || 'SOURCE:' || chr(10) || source_content AS prompt
 FROM segments""",
    "segments",
)
def prompts(spark, sf):
    """A prompt and a preview for every segment."""
    rows = lib.segments(spark, sf)
    asked = text.prompt(F.col("source_content"), F.col("extract_mode"), F.lit("auto"), F.lit("zh-CN"), "{language_instruction} {mode_instruction}")
    return rows.select("segment_id", text.truncated(F.col("source_content")).alias("preview"), asked.alias("prompt"))


@query()
def segment_prompts(spark, sf):
    return prompts(spark, sf)


@query(
    """SELECT segment_id, CASE WHEN t = '' OR regexp_full_match(t, '[^\\w\\p{L}\\p{N}\\p{M}]+') THEN NULL ELSE t END AS spoken FROM (
 SELECT segment_id, source_content AS t FROM segments) """,
    "segments",
)
def speech(spark, sf):
    rows = lib.segments(spark, sf)
    said = text.speech_text(F.col("source_content"), F.lit("p"), F.lit(2), F.col("segment_id"), F.col("xpath"))
    return rows.select("segment_id", said.alias("spoken"))


@query(
    """SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split_regex(replace(replace(replace(replace(replace(text, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), '.' || chr(10), '.' || chr(1)), '!' || chr(10), '!' || chr(1)), chr(1))) AS s FROM documents)
 WHERE trim(s) <> '' GROUP BY doc_id"""
)
def sentence_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


# Skips


def _keyword_sql(words, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(^|[^\\w]){w}($|[^\\w])') THEN '{w}'" for w in words) + " END"


SKIP = f"""found AS (SELECT t.book_id, t.pos, t.title, s.file_path, s.spine_index, count(*) OVER (PARTITION BY t.book_id) AS in_spine,
 {_keyword_sql(skip.KEYWORDS, 'lower(title)')} AS kw, {_keyword_sql(skip.TRIGGERS, 'lower(title)')} AS trig FROM toc t JOIN spine s ON t.book_id = s.book_id AND split_part(t.href, '#', 1) = s.file_path),
sized AS (SELECT book_id, count(*) AS n FROM toc GROUP BY book_id),
titled AS (SELECT book_id, file_path, spine_index, arg_max(kw, pos) AS reason, 'toc' AS source FROM found WHERE kw IS NOT NULL GROUP BY ALL),
trigger AS (SELECT book_id, arg_min(spine_index, pos) AS at, arg_min(trig, pos) AS word FROM found JOIN sized USING (book_id) WHERE trig IS NOT NULL AND pos >= floor(n * 0.7) GROUP BY book_id),
skips AS (SELECT * FROM titled UNION ALL SELECT s.book_id, s.file_path, s.spine_index, 'after ' || word, 'cascade' FROM spine s JOIN trigger t ON s.book_id = t.book_id AND s.spine_index > t.at
 WHERE NOT EXISTS (SELECT 1 FROM titled x WHERE x.book_id = s.book_id AND x.file_path = s.file_path))"""


def _skip_sql(rest: str, *views: str) -> str:
    return with_views("", "toc", *views).rstrip() + ",\n" + SKIP + "\n" + rest


def _skips(spark, sf) -> DataFrame:
    return skip.candidates(lib.toc(spark, sf), lib.spine(spark, sf))


@query(_skip_sql("SELECT book_id, file_path, spine_index, reason, source FROM skips"))
def skip_candidates(spark, sf):
    return _skips(spark, sf)


@query(_skip_sql("SELECT reason, source, count(*) AS n, count(DISTINCT book_id) AS n_books FROM skips GROUP BY reason, source"))
def skip_analysis(spark, sf):
    return reports.skip_counts(_skips(spark, sf))


@query(_skip_sql("SELECT reason, count(*) AS n FROM skips WHERE source = 'cascade' GROUP BY reason"))
def cascade_counts(spark, sf):
    return reports.cascades(_skips(spark, sf))


@query(
    _skip_sql(
        """SELECT norm, count(*) AS n FROM (SELECT DISTINCT f.book_id, lower(title) AS norm FROM found f JOIN sized z USING (book_id)
 WHERE kw IS NULL AND title <> '' AND (pos < 8 OR pos >= greatest(z.n - 6, 0)) AND NOT regexp_matches(title, '[0-9]') AND NOT contains(lower(title), 'chapter') AND NOT contains(lower(title), 'part'))
 GROUP BY norm ORDER BY n DESC, norm LIMIT 10"""
    )
)
def unmatched_top(spark, sf):
    """The ten most frequent titles that no rule names."""
    return reports.top_titles(skip.unmatched_titles(lib.toc(spark, sf), lib.spine(spark, sf)), 10)


@query(
    _skip_sql(
        "SELECT g.book_id, g.segment_id, k.reason AS skip_reason, k.source AS skip_source FROM segments g LEFT JOIN skips k ON g.book_id = k.book_id AND g.file_path = k.file_path",
        "segments",
    )
)
def tagged_segments(spark, sf):
    return skip.tagged(lib.segments(spark, sf), _skips(spark, sf)).select("book_id", "segment_id", "skip_reason", "skip_source")


@query(
    _skip_sql(
        """SELECT a.book_id, a.n_spine, coalesce(b.n, 0) AS n_toc, coalesce(c.n, 0) AS n_processed, coalesce(d.n, 0) AS n_skipped, round(100.0 * coalesce(d.n, 0) / n_spine, 2) AS skipped_percent,
 round(100.0 * coalesce(d.n, 0) / n_spine, 2) > 50 AS warn FROM (SELECT book_id, count(*) AS n_spine FROM spine GROUP BY book_id) a LEFT JOIN sized b USING (book_id)
 LEFT JOIN (SELECT book_id, count(DISTINCT file_path) AS n FROM segments GROUP BY book_id) c USING (book_id) LEFT JOIN (SELECT book_id, count(DISTINCT file_path) AS n FROM skips GROUP BY book_id) d USING (book_id)""",
        "segments",
    )
)
def book_stats(spark, sf):
    return reports.book_stats(lib.spine(spark, sf), lib.toc(spark, sf), lib.segments(spark, sf), _skips(spark, sf))


# State


@query("SELECT s.book_id, s.segment_id, coalesce(t.status, 'pending') AS status FROM segments s LEFT JOIN state t USING (book_id, segment_id)", "state")
def segment_status(spark, sf):
    return st.with_state(lib.segments(spark, sf), lib.state(spark, sf)).select("book_id", "segment_id", "status")


@query("SELECT s.book_id, s.segment_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM state t WHERE t.segment_id = s.segment_id AND t.book_id = s.book_id AND status = 'completed')", "state")
def pending_segments(spark, sf):
    return st.pending(lib.segments(spark, sf), lib.state(spark, sf)).select("book_id", "segment_id")


@query("SELECT t.book_id, t.segment_id FROM state t WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE t.segment_id = s.segment_id AND t.book_id = s.book_id)", "state")
def orphan_records(spark, sf):
    return st.orphans(lib.segments(spark, sf), lib.state(spark, sf)).select("book_id", "segment_id")


@query(
    """SELECT s.book_id, s.segment_id, s.xpath, t.translation FROM segments s JOIN state t USING (book_id, segment_id)
 WHERE status = 'completed' AND translation <> '' AND provider_name IS NOT NULL""",
    "state",
)
def injectable(spark, sf):
    return st.injectable(lib.segments(spark, sf), lib.state(spark, sf)).select("book_id", "segment_id", "xpath", "translation")


@query(
    """SELECT book_id, segment_id, status FROM state UNION ALL SELECT DISTINCT s.book_id, s.segment_id, 'pending' FROM segments s
 WHERE NOT EXISTS (SELECT 1 FROM state t WHERE t.segment_id = s.segment_id AND t.book_id = s.book_id)""",
    "state",
)
def ensured_state(spark, sf):
    return st.ensured(lib.segments(spark, sf), lib.state(spark, sf)).select("book_id", "segment_id", "status")


@query(
    """SELECT t.book_id, t.segment_id, coalesce(u.status, t.status) AS status, CASE WHEN u.status IS NULL THEN t.translation ELSE 'new' END AS translation FROM state t
 LEFT JOIN (SELECT book_id, segment_id, 'completed' AS status FROM segments WHERE order_in_file % 3 = 0) u USING (book_id, segment_id)""",
    "state",
)
def merged_state(spark, sf):
    """Updates for every third segment; ids without a record are left out."""
    state = lib.state(spark, sf)
    new = lib.segments(spark, sf).where("order_in_file % 3 = 0").select("book_id", "segment_id", F.lit("completed").alias("status"), F.lit("new").alias("translation"))
    new = new.withColumns({c: F.lit(None).cast("string") for c in ("provider_name", "error_message")})
    return st.merged(state, new, insert=False).select("book_id", "segment_id", "status", "translation")


@query("SELECT book_id, segment_id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'error' THEN error_message END AS error_message FROM state", "state")
def reset_errors(spark, sf):
    return st.reset_errors(lib.state(spark, sf)).select("book_id", "segment_id", "status", "error_message")


@query(
    """SELECT book_id, segment_id, CASE WHEN coalesce(translation, '') LIKE 'I''m sorry, I can''t%' THEN 'pending' ELSE status END AS status,
 CASE WHEN coalesce(translation, '') NOT LIKE 'I''m sorry, I can''t%' THEN translation END AS translation FROM state""",
    "state",
)
def purged_state(spark, sf):
    return st.purged(lib.state(spark, sf)).select("book_id", "segment_id", "status", "translation")


@query(
    """SELECT book_id, CAST(sum(CASE WHEN coalesce(status, 'pending') NOT IN ('completed', 'skipped') THEN 1 ELSE 0 END) AS BIGINT) AS n_remaining, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_completed,
 CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped, min(CASE WHEN status = 'completed' THEN segment_id END) AS first_completed FROM segments LEFT JOIN state USING (book_id, segment_id) GROUP BY book_id""",
    "state",
)
def resume_info(spark, sf):
    found = st.resume_counts(lib.segments(spark, sf), lib.state(spark, sf))
    return found.select("book_id", F.col("remaining").alias("n_remaining"), F.col("completed").alias("n_completed"), F.col("skipped").alias("n_skipped"), "first_completed")


@query("SELECT book_id, file_path, count(*) AS n_segments, min(spine_index) AS spine_index FROM segments GROUP BY book_id, file_path", "segments")
def files_report(spark, sf):
    return reports.files(lib.segments(spark, sf))


PENDING = """SELECT book_id, file_path, CAST(sum(CASE WHEN coalesce(status, 'pending') <> 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_pending, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_done,
 CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped FROM segments LEFT JOIN state USING (book_id, segment_id) GROUP BY book_id, file_path"""


@query(PENDING, "state")
def pending_report(spark, sf):
    return reports.pending_by_file(lib.segments(spark, sf), lib.state(spark, sf))


@query(
    f"""SELECT book_id, count(*) AS n_files, CAST(sum(CASE WHEN n_pending = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_finished, CAST(sum(n_pending + n_done) AS BIGINT) AS n_segments, CAST(sum(n_done) AS BIGINT) AS n_done FROM ({PENDING}) GROUP BY book_id""",
    "state",
)
def progress(spark, sf):
    return reports.progress(lib.segments(spark, sf), lib.state(spark, sf))


@query(
    "SELECT book_id, count(*) AS n, " + ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s}" for s in ("pending", "completed", "error", "skipped")) + " FROM state GROUP BY book_id",
    "state",
)
def dashboard(spark, sf):
    return reports.dashboard(lib.state(spark, sf))


@query(
    """SELECT book_id, segment_id, CASE WHEN status = 'skipped' THEN 'translation skipped' WHEN regexp_full_match(source_content, '[^\\w\\p{L}\\p{N}\\p{M}]+') THEN 'nothing to speak' END AS skipped_because
 FROM segments LEFT JOIN state USING (book_id, segment_id)""",
    "state",
)
def audio_skips(spark, sf):
    rows = lib.segments(spark, sf).withColumns({"skip_reason": F.lit(None).cast("string"), "element_type": F.lit("p")})
    return st.audio_plan(rows, lib.state(spark, sf)).select("book_id", "segment_id", "skipped_because")


@query(
    """SELECT event_id, user_id, CAST(CASE WHEN failed THEN row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - CASE WHEN first_ok THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS run FROM (
 SELECT *, bool_or(NOT failed) OVER (PARTITION BY user_id, island) AS first_ok FROM (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events))"""
)
def failure_runs(spark, sf):
    """Consecutive failures by user; a success resets the count."""
    found = st.failure_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return found.select("event_id", "user_id", "run")


# Chapters


MARKS = """marks AS (SELECT t.book_id, s.spine_index, s.file_path, arg_min(CASE WHEN title = '' THEN s.file_path ELSE title END, pos) AS title, arg_min(title, pos) AS raw_title FROM toc t
 JOIN spine s ON t.book_id = s.book_id AND split_part(t.href, '#', 1) = s.file_path GROUP BY ALL),
filled AS (SELECT s.*, m.spine_index AS start, m.file_path AS start_file, m.title, m.raw_title FROM spine s ASOF LEFT JOIN marks m ON s.book_id = m.book_id AND s.spine_index >= m.spine_index),
stems AS (SELECT *, 'Doc ' || doc_id AS own FROM filled)"""


def _chapter_sql(rest: str, *views: str) -> str:
    return with_views("", "toc", *views).rstrip() + ",\n" + MARKS + "\n" + rest


@query(
    _chapter_sql(
        """SELECT book_id, coalesce(start, spine_index) AS start, coalesce(title, own) AS title, count(*) AS n_files, min(file_path) AS least_file FROM stems
 WHERE file_path IN (SELECT file_path FROM segments) GROUP BY ALL""",
        "segments",
    )
)
def markdown_chapters(spark, sf):
    segs = lib.segments(spark, sf)
    found = chapters.markdown_blocks(lib.spine(spark, sf), lib.toc(spark, sf), segs)
    return found.select("book_id", "start", "title", F.size("files").cast("long").alias("n_files"), F.array_min("files").alias("least_file"))


AUDIO = """SELECT book_id, file_path, spine_index, coalesce(start_file, file_path) AS chapter_file,
 CASE WHEN coalesce(raw_title, '') <> '' THEN raw_title WHEN start_file IS NOT NULL THEN 'Doc ' || regexp_extract(start_file, '([0-9]+)', 1) ELSE own END AS title
 FROM (SELECT *, max(start) OVER (PARTITION BY book_id) AS last_start FROM stems) WHERE last_start IS NULL OR (start IS NOT NULL AND spine_index <= last_start)"""


@query(_chapter_sql(AUDIO))
def audio_chapters(spark, sf):
    return chapters.audio_chapter_of(lib.spine(spark, sf), lib.toc(spark, sf))


@query(
    _chapter_sql(
        f"""SELECT book_id, chapter_file, count(*) AS n_segments, md5(string_agg(source_content, chr(10) || chr(10) ORDER BY spine_index, order_in_file, source_content)) AS body_md5
 FROM segments JOIN (SELECT book_id, file_path, chapter_file FROM ({AUDIO})) USING (book_id, file_path) GROUP BY book_id, chapter_file""",
        "segments",
    )
)
def chapter_bodies(spark, sf):
    found = chapters.bodies(lib.segments(spark, sf), chapters.audio_chapter_of(lib.spine(spark, sf), lib.toc(spark, sf)))
    return found.select("book_id", "chapter_file", "n_segments", F.md5("body").alias("body_md5"))


@query(
    """SELECT o_custkey, o_orderkey, CAST(coalesce(sum(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 500 AS BIGINT) AS start_ms
 FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) AS d FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders))"""
)
def chapter_starts(spark, sf):
    """Start times as sums of the durations before; orders stand for chapters, their prices for milliseconds."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("position"), F.floor("o_totalprice").cast("long").alias("duration_ms")
    )
    found = chapters.starts_ms(rows, 500)
    return found.select(F.col("book_id").alias("o_custkey"), F.col("position").alias("o_orderkey"), "start_ms")


@query(
    """SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN title = '' THEN 'empty title' END, CASE WHEN timed AND start IS NULL THEN 'missing start' END, CASE WHEN start < 0 THEN 'negative start' END,
 CASE WHEN start <= before THEN 'not after the previous chapter' END, CASE WHEN start > 900 THEN 'beyond the end' END]) AS problem FROM (
 SELECT title, start, lag(start) OVER w AS before, max(start IS NOT NULL) OVER (PARTITION BY book_id) AS timed FROM (SELECT book_id, pos, title, CASE WHEN pos % 5 <> 4 THEN CAST((pos * 37) % 1000 - 10 AS DOUBLE) END AS start FROM toc)
 WINDOW w AS (PARTITION BY book_id ORDER BY pos))) WHERE problem IS NOT NULL GROUP BY problem""",
    "toc",
)
def chapter_problems(spark, sf):
    pos = F.col("pos")
    rows = lib.toc(spark, sf).select("book_id", pos.alias("position"), "title", F.when(pos % 5 != 4, (pos * 37 % 1000 - 10).cast("double")).alias("start"), F.lit(900.0).alias("duration"))
    return chapters.problems(rows).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    """SELECT book_id, arg_max(lang, (n, -f)) AS language FROM (SELECT book_id, lang, count(*) AS n, min(spine_index) AS f FROM spine WHERE spine_index < 20 GROUP BY book_id, lang) GROUP BY book_id""",
    "spine",
)
def language_vote(spark, sf):
    """A book's language: the most frequent among its first twenty documents."""
    samples = lib.spine(spark, sf).where("spine_index < 20").select("book_id", F.col("spine_index").alias("pos"), F.col("lang").alias("language"))
    return reports.language_votes(samples)


@query(
    """SELECT xs AS file_stem, count(*) AS n FROM (SELECT segment_id, split_part(segment_id, '-', 2) AS xs FROM segments) GROUP BY xs HAVING count(*) > 1""",
    "segments",
)
def id_collisions(spark, sf):
    """Digests that several files share: positional paths repeat from file to file."""
    rows = lib.segments(spark, sf).select(F.lit("library").alias("book_id"), F.substring_index("segment_id", "-", -1).alias("segment_id"))
    return reports.collisions(rows).select(F.col("segment_id").alias("file_stem"), "n")


# Markup: Python operators over pages, without SQL


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the documents of the book of their host."""
    rows = table(spark, sf_dir, "pages").select("page_id", paths.folder_of(F.regexp_extract("url", r"://([^?#]*)", 1)).alias("at"), "html")
    host = F.substring_index("at", "/", 1)
    return rows.select(
        host.alias("book_id"), F.concat(F.lit("Text/page_"), "page_id", F.lit(".xhtml")).alias("file_path"), F.col("page_id").cast("int").alias("spine_index"), "html"
    )


def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.unique_ids(segments.segment_documents(page_documents(spark, sf_dir)))


#: Markup as text: tags gone, the references that the pages use decoded, white space made single.
_TEXT_SQL = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""
_DOTS_SQL = r"regexp_replace(regexp_replace({0}, '\.\s+\.\s+\.(\s+\.)*', '...', 'g'), '\.\.\.\s*([^\s])', '... \1', 'g')"
_PAGE_TEXT_SQL = _DOTS_SQL.format(_TEXT_SQL)
#: The blocks of the test tables' pages by regular expressions, apart from the tree that the segmenter builds.
PAGE_SQL = f"""art AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*', ''), '://([^/]*)/', 1) AS book_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1) AS menu, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
 regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, string_split(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>')[2:] AS paras FROM pages),
parts AS (SELECT book_id, page_id, 1 AS k, 'ul' AS element_type, '/html/body/nav/ul' AS xpath, trim(regexp_replace(replace(menu, '&quot;', '"'), '</?a[^>]*>', '', 'g')) AS source_content FROM art
 UNION ALL SELECT book_id, page_id, 2, 'div', '/html/body/div', {_PAGE_TEXT_SQL.format("ad")} FROM art
 UNION ALL SELECT book_id, page_id, 3, 'h1', '/html/body/article/h1', {_PAGE_TEXT_SQL.format("head")} FROM art
 UNION ALL SELECT book_id, page_id, 3 + i, 'p', '/html/body/article/p' || CASE WHEN n > 1 THEN '[' || i || ']' ELSE '' END, {_PAGE_TEXT_SQL.format("p")} FROM (
  SELECT book_id, page_id, len(paras) AS n, unnest(paras) AS p, generate_subscripts(paras, 1) AS i FROM art)),
psegs AS (SELECT book_id, 'page_' || page_id || '-' || substr(sha1(xpath), 1, 12) AS segment_id, 'Text/page_' || page_id || '.xhtml' AS file_path, xpath, CASE element_type WHEN 'ul' THEN 'html' ELSE 'text' END AS extract_mode,
 source_content, element_type, CAST(page_id AS INT) AS spine_index, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS order_in_file FROM parts WHERE source_content <> '')"""


@query(f"WITH {PAGE_SQL} SELECT * FROM psegs")
def page_segments(spark, sf):
    """Segments of web pages: paragraphs and headings as text, lists as markup, with unique ids."""
    return html_segments(spark, sf)


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<ul>')) AS n_lists, CAST(sum(1) AS BIGINT) AS n_pages FROM pages GROUP BY ALL"""
)
def page_lists(spark, sf):
    """Lists of each page as the segmenter finds them; an HTML segment each."""
    found = html_segments(spark, sf).groupBy("spine_index").agg(F.count_if(F.col("element_type") == "ul").alias("n_lists"))
    return found.select(F.col("spine_index").cast("long").alias("page_id"), "n_lists", F.lit(1).cast("long").alias("n_pages"))


@query("SELECT page_id, " + _TEXT_SQL.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + " AS raw_title FROM pages")
def page_titles(spark, sf):
    """Headings of all pages by segmentation, character references decoded."""
    heads = html_segments(spark, sf).where("element_type = 'h1'")
    return heads.select(F.col("spine_index").cast("long").alias("page_id"), F.col("source_content").alias("raw_title"))


@query(
    "SELECT page_id, coalesce(nullif(h, ''), nullif(t, '')) AS title FROM (SELECT page_id, "
    + _TEXT_SQL.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + " AS h, "
    + _TEXT_SQL.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
    + " AS t FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?s)<h1>.*?</h1>', '') ELSE html END AS html FROM pages))"
)
def document_titles(spark, sf):
    """The title of each page: its h1, else its title element; every third page has lost its h1."""
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?s)<h1>.*?</h1>", "")).otherwise(F.col("html"))
    rows = table(spark, sf, "pages").select("page_id", html.alias("html"))
    return segments.column_map(rows, segments.document_title, ["html"], "title", ["page_id"])


@query()
def heading_titles(spark, sf):
    return page_titles(spark, sf)


_LI_SQL = _TEXT_SQL.format("li")


@query(
    f"""WITH {PAGE_SQL}, items AS (SELECT page_id, trim(string_agg(CASE WHEN regexp_matches(t, '[.!?…]$') THEN t ELSE t || '. ' END, '' ORDER BY i)) AS said FROM (
 SELECT page_id, i, {_LI_SQL} AS t FROM (SELECT page_id, unnest(regexp_extract_all(menu, '(?s)<li>(.*?)</li>', 1)) AS li, generate_subscripts(regexp_extract_all(menu, '(?s)<li>(.*?)</li>', 1), 1) AS i FROM art)) WHERE t <> '' GROUP BY page_id),
 raw AS (SELECT page_id, 2 AS k, {_TEXT_SQL.format("ad")} AS t FROM art UNION ALL SELECT page_id, 3, {_TEXT_SQL.format("head")} FROM art
 UNION ALL SELECT page_id, 3 + i, {_TEXT_SQL.format("p")} FROM (SELECT page_id, unnest(paras) AS p, generate_subscripts(paras, 1) AS i FROM art) UNION ALL SELECT page_id, 1, said FROM items),
 spoke AS (SELECT book_id, segment_id, element_type, order_in_file, regexp_replace(regexp_replace(t, '(\\.\\s+){{2,}}\\.', '...', 'g'), '(\\.\\s+){{2,}}\\.', '...', 'g') AS t FROM psegs JOIN raw ON page_id = spine_index AND k = CASE element_type
  WHEN 'ul' THEN 1 WHEN 'div' THEN 2 WHEN 'h1' THEN 3 ELSE 3 + coalesce(TRY_CAST(regexp_extract(xpath, 'p\\[([0-9]+)\\]$', 1) AS INT), 1) END)
 SELECT book_id, segment_id, CASE WHEN t = '' OR regexp_full_match(t, '[^\\w\\p{{L}}\\p{{N}}\\p{{M}}]+') THEN NULL ELSE t END AS spoken FROM spoke"""
)
def page_speech(spark, sf):
    """What is read aloud of each segment, by its document: lists with stops, notes left out."""
    marked = segments.spoken(html_segments(spark, sf), page_documents(spark, sf))
    said = text.speech_text(F.col("from_source"), F.col("element_type"), F.col("order_in_file"), F.col("segment_id"), F.col("xpath"))
    return marked.select("book_id", "segment_id", said.alias("spoken"))


@query(
    r"""SELECT book_id, file_path, CASE WHEN ends_with(x, '</html>') THEN x ELSE x || '</body></html>' END AS cleaned FROM (SELECT regexp_extract(regexp_replace(url, '[?#].*', ''), '://([^/]*)/', 1) AS book_id, 'Text/page_' || page_id || '.xhtml' AS file_path, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&([^a-z#]|a[^m]|am[^p])', '&amp;\1', 'g'), '&amp;amp;', '&amp;', 'g'),
 '^<!DOCTYPE html>', ''), ' lang="[^"]*"', '', 'g'), '(?s)<meta[^>]*>|<script>.*?</script>', '', 'g'), ' class="ad"', '', 'g'), '<p><b>(.*?<br>)', '<p><b>\1</b></p>', 'g'), 'href="/', 'href="content/Text/', 'g'),
 '&amp([^;a-z])', '&amp;\1', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS x FROM pages)"""
)
def cleaned_pages(spark, sf):
    """Pages without active content, their links and media pointing into the export."""
    rows = page_documents(spark, sf)
    return segments.column_map(rows, web.cleaned, ["html", "file_path"], "cleaned", ["book_id", "file_path"])


def _shown(markup: str) -> str:
    """SQL of the text of markup, with the references of the pages' footers too."""
    return _TEXT_SQL.replace("replace(regexp_replace({0}", "replace(replace(replace(regexp_replace({0}").replace("'&quot;', '\"')", "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"')").format(markup)


@query(
    f"""WITH {PAGE_SQL}, menu AS (SELECT page_id, string_agg('* [' || {_shown("li[2]")} || '](' || {_shown("li[1]")} || ')', chr(10) ORDER BY i) AS t FROM (
 SELECT page_id, i, [regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '(?s)<a[^>]*>(.*?)</a>', 1)] AS li FROM (SELECT page_id, unnest(regexp_extract_all(menu, '(?s)<li>(.*?)</li>', 1)) AS x, generate_subscripts(regexp_extract_all(menu, '(?s)<li>(.*?)</li>', 1), 1) AS i FROM art)) GROUP BY page_id),
 pieces AS (SELECT page_id, 1 AS k, t FROM menu UNION ALL SELECT page_id, 2, {_shown("ad")} FROM art UNION ALL SELECT page_id, 3, '# ' || {_shown("head")} FROM art
 UNION ALL SELECT page_id, 3 + i, CASE WHEN starts_with(p, '<b>') THEN '**' || {_shown("p")} || '**' ELSE {_shown("p")} END FROM (SELECT page_id, unnest(paras) AS p, generate_subscripts(paras, 1) AS i FROM art)
 UNION ALL SELECT page_id, 100000, {_shown("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} FROM pages)
 SELECT book_id, file_path, markdown FROM (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS markdown FROM pieces WHERE t <> '' GROUP BY page_id)
 JOIN (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*', ''), '://([^/]*)/', 1) AS book_id, 'Text/page_' || page_id || '.xhtml' AS file_path FROM pages) USING (page_id)"""
)
def page_markdown(spark, sf):
    rows = page_documents(spark, sf)
    return segments.column_map(rows, web.markdown, ["html", "file_path"], "markdown", ["book_id", "file_path"])


@query(
    f"""WITH {PAGE_SQL} SELECT book_id, segment_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS preview FROM (
 SELECT book_id, segment_id, CASE element_type WHEN 'ul' THEN trim(regexp_replace(regexp_replace(replace(source_content, '&amp;', '&'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))
 ELSE regexp_replace(source_content, '<[^>]*>', '', 'g') END AS t FROM psegs)"""
)
def page_previews(spark, sf):
    rows = segments.column_map(html_segments(spark, sf), segments.stripped, ["source_content"], "bare", ["book_id", "segment_id"])
    return rows.select("book_id", "segment_id", text.truncated(F.col("bare")).alias("preview"))


@query(
    f"""WITH {PAGE_SQL} SELECT book_id, segment_id, 'completed' AS status, CASE WHEN class = 'translate' THEN '[Simplified Chinese] ' || upper(replace(t, 'ß', 'ss')) ELSE t END AS translation,
 CASE WHEN class = 'translate' THEN 'stub' END AS provider_name, CASE WHEN class = 'translate' THEN 'upper' END AS model_name, CAST(NULL AS VARCHAR) AS error_message FROM (
 SELECT *, {COPY} AS class FROM (SELECT book_id, segment_id, source_content AS t FROM psegs))"""
)
def translated_segments(spark, sf):
    """Segments through the stub translator; copied where no model is needed."""
    return models.translate(html_segments(spark, sf), models.Stub, "auto", "Simplified Chinese")


def _answers(spark, sf) -> DataFrame:
    rows = html_segments(spark, sf)
    done = translated_segments(spark, sf).where("status = 'completed' and provider_name is not null")
    return rows.join(done.select("book_id", "segment_id", "translation"), ["book_id", "segment_id"])


@query()
def bilingual_pages(spark, sf):
    """Pages with each translation behind its original."""
    return segments.inject(page_documents(spark, sf), _answers(spark, sf), "bilingual").select("book_id", "file_path", "html", F.size("lost").alias("n_lost"))


@query()
def translated_pages(spark, sf):
    """Pages with translations in the place of the originals."""
    return segments.inject(page_documents(spark, sf), _answers(spark, sf), "translated_only").select("book_id", "file_path", "html", F.size("lost").alias("n_lost"))


@query(
    f"""WITH {PAGE_SQL} SELECT book_id, file_path, CAST(NULL AS VARCHAR) AS fragment, '[Simplified Chinese] ' || source_content AS title FROM psegs WHERE element_type = 'h1'"""
)
def translated_headings(spark, sf):
    """The translation of each page's heading; the stub's capitals are undone by taking the text from the segment."""
    rows = html_segments(spark, sf)
    done = _answers(spark, sf)
    found = segments.headings(done.withColumn("translation", F.concat(F.regexp_extract("translation", r"^\[[^\]]*\] ", 0), "source_content")), page_documents(spark, sf))
    return found


@query(
    """SELECT book_id, chapter_file, segment_id, CAST(row_number() OVER w AS BIGINT) AS position, CAST(coalesce(sum(ms + 250) OVER (PARTITION BY book_id, chapter_file ORDER BY spine_index, order_in_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM (
 SELECT g.*, c.chapter_file, length(source_content) * 60 AS ms FROM segments g JOIN (SELECT book_id, file_path, chapter_file FROM ("""
    + "{AUDIO}" + """)) c USING (book_id, file_path) JOIN state t USING (book_id, segment_id) WHERE t.status = 'completed') WINDOW w AS (PARTITION BY book_id, chapter_file ORDER BY spine_index, order_in_file)"""
)
def assembly_plan(spark, sf):
    """The order and start of finished segments in each chapter; sixty milliseconds a character, a pause between."""
    rows = lib.segments(spark, sf)
    done = lib.state(spark, sf).where("status = 'completed'").join(rows.select("book_id", "segment_id", "source_content"), ["book_id", "segment_id"])
    audio_rows = done.select("book_id", "segment_id", "status", F.concat("segment_id", F.lit(".m4a")).alias("audio_path"), (F.length("source_content") * 60 / 1000).alias("duration_seconds"))
    found = audio.assembly(rows, chapters.audio_chapter_of(lib.spine(spark, sf), lib.toc(spark, sf)), audio_rows, 250)
    return found.select("book_id", "chapter_file", "segment_id", F.col("position").cast("long").alias("position"), "start_ms")


SQL["assembly_plan"] = _chapter_sql(SQL["assembly_plan"].replace("{AUDIO}", AUDIO), "state")


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def engine_aggregate(spark, sf):
    """Not from the reference: a plain aggregate as a smoke test of the engine."""
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query(
    """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY o_orderpriority"""
)
def engine_join(spark, sf):
    """Not from the reference: a join as a smoke test of the engine."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


# Exports


@query(
    """SELECT book_id, spine_index, 'content/' || file_path AS href, CASE WHEN coalesce(trim(t.title), '') <> '' THEN t.title ELSE 'doc_' || doc_id END AS title
 FROM spine s LEFT JOIN (SELECT book_id, split_part(href, '#', 1) AS file_path, title FROM toc) t USING (book_id, file_path)""",
    "toc",
)
def web_spine(spark, sf):
    named = chapters.titles_by_file(lib.toc(spark, sf))
    return export.web_spine(lib.spine(spark, sf), named).withColumn("spine_index", F.col("spine_index").cast("long"))


@query(
    _chapter_sql(
        f"""SELECT book_id, chapter_file, title, count(DISTINCT file_path) AS n_files, count(*) AS n_segments, min(spine_index) AS spine_index
 FROM segments JOIN (SELECT book_id, file_path, chapter_file, title FROM ({AUDIO})) USING (book_id, file_path) GROUP BY book_id, chapter_file, title""",
        "segments",
    )
)
def chapter_preview(spark, sf):
    found = export.preview(chapters.audio_chapter_of(lib.spine(spark, sf), lib.toc(spark, sf)), lib.segments(spark, sf))
    return found.select("book_id", "chapter_file", "title", F.size("files").cast("long").alias("n_files"), "n_segments", "spine_index")


@query(
    _skip_sql(
        """SELECT book_id, 'document' AS kind, file_path AS name, reason FROM skips UNION ALL
 SELECT book_id, 'segment', segment_id, coalesce(error_message, '') FROM state JOIN segments USING (book_id, segment_id) WHERE status = 'skipped'""",
        "state",
    )
)
def skip_list(spark, sf):
    return export.skip_list(_skips(spark, sf), lib.state(spark, sf), lib.segments(spark, sf))


@query(
    _skip_sql(
        """SELECT book_id, file_path, coalesce(a.spine_index, 9999) AS spine_index, k.reason IS NULL AS active FROM (SELECT book_id, file_path, min(spine_index) AS spine_index FROM segments GROUP BY ALL) a
 FULL JOIN skips k USING (book_id, file_path)""",
        "segments",
    )
)
def template_files(spark, sf):
    return export.template_files(lib.segments(spark, sf), _skips(spark, sf))


@query(
    """SELECT book_id, pos, href, CASE WHEN pos % 3 = 0 THEN 'T' || pos WHEN pos % 3 = 1 THEN 'F' ELSE title END AS title FROM toc""", "toc"
)
def toc_titles(spark, sf):
    """Entries take the heading at their fragment, then the one of their file."""
    toc = lib.toc(spark, sf)
    rows = toc.select("book_id", paths.file_of(F.col("href")).alias("file_path"), "pos")
    heads = rows.where("pos % 3 = 0").select("book_id", "file_path", F.lit("top").alias("fragment"), F.concat(F.lit("T"), "pos").alias("title"))
    heads = heads.union(rows.where("pos % 3 <> 2").select("book_id", "file_path", F.lit(None), F.lit("F")))
    return export.toc_titles(toc, heads)


@query(
    """SELECT host, name, CASE WHEN nth = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]*)$', '') || '_' || nth || regexp_extract(name, '(\\.[^.]*)$', 1) END AS unique_name FROM (
 SELECT host, name, row_number() OVER (PARTITION BY host, name ORDER BY page_id) AS nth FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, 'p' || page_id % 4 || '.png' AS name FROM pages))"""
)
def image_names(spark, sf):
    rows = table(spark, sf, "pages").select(
        F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("book_id"), F.concat(F.lit("i/p"), F.col("page_id") % 4, F.lit(".png")).alias("file_path"), F.col("page_id").alias("pos")
    )
    found = export.image_names(rows)
    return found.select(F.col("book_id").alias("host"), F.substring_index("file_path", "/", -1).alias("name"), F.col("name").alias("unique_name"))


@query(
    """SELECT book_id, count(*) AS n_current FROM (SELECT book_id, file_path FROM segments GROUP BY book_id, file_path HAVING max(order_in_file) % 2 = 0) GROUP BY book_id""",
    "segments",
)
def cached_chapters(spark, sf):
    """Chapters whose built form is current; here those with an even number of segments were built from all of them."""
    rows = lib.segments(spark, sf).groupBy("book_id", F.col("file_path").alias("chapter_file")).agg(
        F.sort_array(F.collect_list("order_in_file")).alias("ids"), F.lit(5).alias("newest"), F.max("order_in_file").alias("n")
    )
    manifest = rows.select("book_id", "chapter_file", F.when(F.col("n") % 2 == 0, F.col("ids")).otherwise(F.slice("ids", F.lit(2), F.size("ids"))).alias("ids"), F.lit(9).alias("built"))
    return chapters.cache_valid(rows, manifest).where("current").groupBy("book_id").agg(F.count("*").alias("n_current"))


# Operators that the queries above don't reach


@query("SELECT book_id, segment_id FROM segments WHERE doc_id % 5 = 0", "segments")
def chosen_segments(spark, sf):
    """Segments of listed files; every fifth document is on the list."""
    listed = lib.spine(spark, sf).where("doc_id % 5 = 0").select("book_id", "file_path")
    return st.chosen(lib.segments(spark, sf), listed).select("book_id", "segment_id")


@query(_skip_sql("SELECT book_id, segment_id FROM segments g WHERE NOT EXISTS (SELECT 1 FROM skips k WHERE k.book_id = g.book_id AND k.file_path = g.file_path)", "segments"))
def unskipped_segments(spark, sf):
    """Without a list, segments of the files that no rule skips."""
    return st.chosen(skip.tagged(lib.segments(spark, sf), _skips(spark, sf)), None).select("book_id", "segment_id")


def _spoken_plan(spark, sf) -> DataFrame:
    rows = lib.segments(spark, sf).withColumns({"skip_reason": F.lit(None).cast("string"), "element_type": F.lit("p")})
    return st.audio_plan(rows, lib.state(spark, sf))


def _audio_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(audio records, files that are there): of every third finished segment the file is lost."""
    done = lib.segments(spark, sf).join(lib.state(spark, sf).select("book_id", "segment_id", "status"), ["book_id", "segment_id"])
    rows = done.select("book_id", "segment_id", "status", F.concat("book_id", F.lit("/"), "segment_id", F.lit(".m4a")).alias("audio_path"), "order_in_file")
    there = rows.where("order_in_file % 3 <> 0").select(F.col("audio_path").alias("path"))
    return rows.drop("order_in_file"), there


_AUDIO_TODO = """SELECT g.* FROM segments g LEFT JOIN state s USING (book_id, segment_id) WHERE coalesce(s.status, '') <> 'skipped'
 AND NOT regexp_full_match(source_content, '[^\\w\\p{L}\\p{N}\\p{M}]+') AND NOT (coalesce(s.status, '') = 'completed' AND order_in_file % 3 <> 0)"""


@query(f"SELECT book_id, segment_id FROM ({_AUDIO_TODO})", "state")
def audio_pending(spark, sf):
    """Segments to be spoken: without audio, or with audio whose file is lost."""
    audio_rows, there = _audio_rows(spark, sf)
    return st.audio_pending(_spoken_plan(spark, sf), audio_rows, there).select("book_id", "segment_id")


@query(
    f"SELECT book_id, count(*) AS n_missing, arg_min(segment_id, (spine_index, order_in_file)) AS first_missing FROM ({_AUDIO_TODO}) GROUP BY book_id", "state"
)
def audio_missing(spark, sf):
    return st.audio_missing(_spoken_plan(spark, sf), *_audio_rows(spark, sf))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Own' WHEN doc_id % 5 = 0 THEN 'Entry' WHEN doc_id % 3 = 0 THEN 'Heading' ELSE 'Doc ' || doc_id END AS title FROM documents"""
)
def chapter_titles(spark, sf):
    """The first title that isn't blank: a custom one, the contents' entry, the document's heading, the file's name."""
    k = F.col("doc_id")
    custom, entry = F.when(k % 7 == 0, "Own"), F.when(k % 5 == 0, "Entry").otherwise("")
    heading = F.when(k % 3 == 0, "Heading").otherwise("  ")
    return table(spark, sf, "documents").select("doc_id", chapters.chapter_title(custom, entry, heading, F.concat(F.lit("Text/doc_"), k, F.lit(".xhtml"))).alias("title"))


_VOICES = ("en-US-AriaNeural", "zh-CN-XiaoxiaoMultilingualNeural", "de-DE-Kat-Ja", "alloy", "fr-FR-Neural", "x-y-_Bob-Turbo")


@query(
    f"""SELECT o_orderkey, CASE WHEN trim(n, '-_') = '' THEN v ELSE trim(n, '-_') END AS narrator FROM (SELECT o_orderkey, v, regexp_replace(regexp_replace(regexp_replace(
 CASE WHEN len(string_split(v, '-')) >= 3 THEN array_to_string(string_split(v, '-')[3:], '-') ELSE v END, 'Neural$', ''), 'Multilingual$', ''), 'Turbo$', '') AS n FROM (
 SELECT o_orderkey, ([{", ".join(f"'{v}'" for v in _VOICES)}])[CAST(o_orderkey % {len(_VOICES)} AS INT) + 1] AS v FROM orders))"""
)
def narrators(spark, sf):
    voice = F.element_at(F.array(*map(F.lit, _VOICES)), (F.col("o_orderkey") % len(_VOICES) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.narrator(voice).alias("narrator"))


@query(
    """SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, ', ', '。'), '([。？！…；.!?])\\s*', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
 WHERE trim(s) <> '' GROUP BY doc_id"""
)
def cjk_sentences(spark, sf):
    """Sentences that end without white space; commas stand for ideographic full stops."""
    said = text.sentences(F.replace(F.col("text"), F.lit(", "), F.lit("。")), cjk=True)
    rows = table(spark, sf, "documents").select("doc_id", F.explode(said).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


_IDS = ("ftn", "footnote-", "fnord", "note_", "my note ", "banknote", "x-rearnote", "Endnote-")


@query(
    f"""SELECT o_orderkey, len(list_filter(string_split_regex(lower(v), '[\\s_\\-]+'), lambda p: regexp_full_match(p, '(footnote|endnote|rearnote|ftn|fn|note)[0-9]*'))) > 0 AS names_note FROM (
 SELECT o_orderkey, ([{", ".join(f"'{v}'" for v in _IDS)}])[CAST(o_orderkey % {len(_IDS)} AS INT) + 1] || o_orderkey AS v FROM orders)"""
)
def note_identifiers(spark, sf):
    value = F.concat(F.element_at(F.array(*map(F.lit, _IDS)), (F.col("o_orderkey") % len(_IDS) + 1).cast("int")), F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", text.note_identifier(value).alias("names_note"))


@query("SELECT page_id, 'file ''' || replace(p, '''', '''\\''''') || '''' AS line FROM (SELECT page_id, '/a/it''s ' || page_id || '/' || url AS p FROM pages)")
def concat_lines(spark, sf):
    path = F.concat(F.lit("/a/it's "), "page_id", F.lit("/"), "url")
    return table(spark, sf, "pages").select("page_id", text.concat_line(path).alias("line"))


@query(
    """SELECT o_orderkey, regexp_replace(regexp_replace(v, '(\\.\\s+){2,}\\.', '...', 'g'), '(\\.\\s+){2,}\\.', '...', 'g') AS spoken FROM (
 SELECT o_orderkey, 'a' || repeat(' .', CAST(o_orderkey % 6 AS INT)) || CASE WHEN o_orderkey % 2 = 0 THEN ' b' ELSE '.  . .c' END AS v FROM orders)"""
)
def spoken_dots(spark, sf):
    """Spaced full stops as they are read aloud."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit("a"), F.repeat(F.lit(" ."), (k % 6).cast("int")), F.when(k % 2 == 0, " b").otherwise(".  . .c"))
    return table(spark, sf, "orders").select("o_orderkey", text.spoken_dots(value).alias("spoken"))


@query(
    """SELECT book_id, segment_id, CASE WHEN status = 'completed' AND translation IS NOT NULL THEN '译 ' || n || ' 字 —— ' || n || ' 完... 好' ELSE NULL END AS translation FROM (
 SELECT t.*, length(segment_id) AS n FROM state t)""",
    "state",
)
def polished_state(spark, sf):
    """Completed Chinese translations in uniform typography; other records keep what they have."""
    n = F.length("segment_id")
    rough = F.concat(F.lit("译"), n, F.lit("字--"), n, F.lit("完 . . . 好"))
    rows = lib.state(spark, sf).withColumn("translation", F.when(F.col("translation").isNotNull() & (F.col("status") == "completed"), rough))
    return st.polished(rows).select("book_id", "segment_id", "translation")


@query(
    """SELECT book_id, segment_id, CASE status WHEN 'completed' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'completed' THEN segment_id || '.m4a' END AS audio_path,
 CASE WHEN status <> 'completed' THEN CAST(length(segment_id) AS DOUBLE) END AS duration_seconds FROM state""",
    "state",
)
def invalidated_audio(spark, sf):
    """Audio records after the voice has changed."""
    rows = lib.state(spark, sf).select("book_id", "segment_id", "status", F.concat("segment_id", F.lit(".m4a")).alias("audio_path"), F.length("segment_id").cast("double").alias("duration_seconds"))
    return st.invalidated(rows, {"voice": "a"}, {"voice": "b", "cover": "c"})


_IMAGES_SQL = "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS book_id, page_id AS pos, 'i/' || CASE WHEN page_id % 13 = 5 THEN 'Cover' ELSE 'p' END || page_id || '.png' AS file_path FROM pages"


@query(
    f"""WITH im AS ({_IMAGES_SQL}), marked AS (SELECT * FROM im WHERE pos % 29 = 3 UNION ALL SELECT book_id, pos, 'gone.png' FROM im),
 used AS (SELECT book_id, pos % 5 AS nth, pos, file_path FROM im WHERE pos % 7 = 2)
 SELECT book_id, coalesce(a, b, c, d) AS cover FROM (SELECT book_id, arg_min(file_path, pos) AS d, arg_min(file_path, pos) FILTER (contains(lower(file_path), 'cover')) AS c FROM im GROUP BY book_id)
 LEFT JOIN (SELECT book_id, min(file_path) AS a FROM marked WHERE file_path <> 'gone.png' GROUP BY book_id) USING (book_id)
 LEFT JOIN (SELECT book_id, arg_min(file_path, (nth, pos)) AS b FROM used GROUP BY book_id) USING (book_id)"""
)
def covers(spark, sf):
    """Marked images, images in reading order, images named cover, first images; some marks lead nowhere."""
    k = F.col("page_id")
    name = F.concat(F.lit("i/"), F.when(k % 13 == 5, "Cover").otherwise("p"), k, F.lit(".png"))
    found = table(spark, sf, "pages").select(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("book_id"), k.alias("pos"), name.alias("file_path"))
    marked = found.where("pos % 29 = 3").select("book_id", "file_path").union(found.select("book_id", F.lit("gone.png")))
    used = found.where("pos % 7 = 2").select("book_id", (F.col("pos") % 5).alias("spine_index"), "pos", "file_path")
    return export.covers(found, marked, used)


@query(
    """SELECT source AS book_id, arg_min('T' || doc_id, doc_id) AS title, arg_min(lang, doc_id) FILTER (doc_id % 3 = 0) AS creator, CAST(NULL AS VARCHAR) AS publisher,
 arg_min(CASE WHEN doc_id % 2 = 0 THEN CAST(1900 + doc_id % 100 AS VARCHAR) ELSE 'about ' || doc_id END, doc_id) AS year FROM documents GROUP BY source"""
)
def book_metadata(spark, sf):
    """The first value of each field; documents of a source stand for the entries of its package."""
    k = F.col("doc_id")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    date = F.when(k % 2 == 0, F.concat((1900 + k % 100).cast("string"), F.lit("-01-02"))).otherwise(F.concat(F.lit("about "), k))
    own = F.array(entry("title", F.concat(F.lit("T"), k)), entry("creator", F.when(k % 3 == 0, F.col("lang"))), entry("date", date))
    rows = table(spark, sf, "documents").select(F.col("source").alias("book_id"), k.alias("pos"), F.explode(own).alias("m"))
    return export.first_values(rows.select("book_id", "pos", "m.*").where("value is not null"))


_KEYS = ("mimetype", "META-INF/container.xml", "a/b/x{}.OPF", "c/x{}.opf", "t{}.ncx", "d/t{}.ncx", "page{}.html")


@query(
    f"""SELECT book_id, kind, arg_min(member, (length(member) - length(replace(member, '/', '')), lower(member))) AS member FROM (SELECT *, CASE WHEN regexp_matches(lower(member), '(^|/)mimetype$') THEN 'mimetype'
 WHEN ends_with(lower(member), 'container.xml') THEN 'container' WHEN ends_with(lower(member), '.opf') THEN 'opf' WHEN ends_with(lower(member), '.ncx') THEN 'ncx' END AS kind FROM (
 SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS book_id, replace(([{", ".join(f"'{m}'" for m in _KEYS)}])[CAST(page_id % {len(_KEYS)} AS INT) + 1], '{{}}', CAST(page_id AS VARCHAR)) AS member FROM pages)) WHERE kind IS NOT NULL GROUP BY book_id, kind"""
)
def key_files(spark, sf):
    k = F.col("page_id")
    name = F.replace(F.element_at(F.array(*map(F.lit, _KEYS)), (k % len(_KEYS) + 1).cast("int")), F.lit("{}"), k.cast("string"))
    return export.key_files(table(spark, sf, "pages").select(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("book_id"), name.alias("member")))


@query(
    """SELECT page_id, starts_with(m, '/') OR starts_with(m, '\\') OR regexp_matches(m, '^[A-Za-z]:') OR list_contains(string_split_regex(m, '[/\\\\]'), '..') AS unsafe FROM (
 SELECT page_id, (['a/', '/a/', 'c:', 'a/../', '..\\', '\\\\h\\', 'a..b/', './'])[CAST(page_id % 8 AS INT) + 1] || url AS m FROM pages)"""
)
def unsafe_members(spark, sf):
    start = F.element_at(F.array(*map(F.lit, ("a/", "/a/", "c:", "a/../", "..\\", "\\\\h\\", "a..b/", "./"))), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", paths.unsafe_member(F.concat(start, "url")).alias("unsafe"))


@query(
    _skip_sql(
        """SELECT book_id, coalesce(n_pending, 0) AS n_pending, coalesce(n_auto_skipped, 0) AS n_auto_skipped, coalesce(n_orphans, 0) AS n_orphans FROM (
 SELECT book_id, CAST(sum(CASE WHEN w AND k.reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_pending, count(CASE WHEN w THEN k.reason END) AS n_auto_skipped FROM (SELECT g.book_id, g.file_path, coalesce(t.status, 'pending') = 'pending' AS w FROM segments g LEFT JOIN state t ON g.book_id = t.book_id AND g.segment_id = t.segment_id) g
 LEFT JOIN skips k USING (book_id, file_path) GROUP BY book_id)
 FULL JOIN (SELECT book_id, count(*) AS n_orphans FROM state t WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = t.segment_id AND s.book_id = t.book_id) GROUP BY book_id) USING (book_id)""",
        "state",
    )
)
def pending_totals(spark, sf):
    """Segments of each book that wait for translation, those of skipped files, and records without a segment."""
    return reports.pending_totals(skip.tagged(lib.segments(spark, sf), _skips(spark, sf)), lib.state(spark, sf))


@query(_skip_sql("SELECT (SELECT count(DISTINCT book_id) FROM spine) AS n_processed, count(DISTINCT book_id) AS n_with_skips FROM skips"))
def library_totals(spark, sf):
    return reports.library_totals(lib.spine(spark, sf), _skips(spark, sf))


@query("SELECT book_id, segment_id, error_message FROM state WHERE status = 'error' ORDER BY book_id, segment_id LIMIT 10", "state")
def first_errors(spark, sf):
    """The first ten errors of a report."""
    rows = lib.state(spark, sf).where("status = 'error'").select("book_id", "segment_id", "error_message")
    return reports.first_rows(rows, ["book_id", "segment_id"], 10)


@query(
    _skip_sql(
        """SELECT k.book_id, k.file_path, g.spine_index, k.reason, k.source, k.file_path NOT LIKE '%5.xhtml' AS flagged FROM skips k LEFT JOIN (
 SELECT book_id, file_path, min(spine_index) AS spine_index FROM segments GROUP BY ALL) g USING (book_id, file_path)""",
        "segments",
    )
)
def skip_flags(spark, sf):
    """Skipped files in reading order; a reader takes those ending in 5 back."""
    skips = _skips(spark, sf)
    taken = skips.where("file_path like '%5.xhtml'").select("book_id", "file_path", F.lit(False).alias("flagged"))
    return export.skip_flags(lib.segments(spark, sf), skips, taken)


@query(
    """SELECT book_id, file_path, count(*) AS n FROM segments WHERE doc_id % 9 = 4 GROUP BY book_id, file_path""", "segments"
)
def missing_documents(spark, sf):
    """Files with translations whose document is gone: every ninth."""
    docs = lib.spine(spark, sf).where("doc_id % 9 <> 4").select("book_id", "file_path")
    return segments.missing_documents(docs, lib.segments(spark, sf))


@query(
    """SELECT book_id, segment_id, coalesce(u.status, t.status) AS status, coalesce(u.at, CAST(t.at AS VARCHAR)) AS updated_at FROM (SELECT book_id, segment_id, status, CAST(NULL AS VARCHAR) AS at FROM state) t
 FULL JOIN (SELECT book_id, segment_id, 'completed' AS status, '2020-01-02 03:04:05' AS at FROM segments WHERE order_in_file % 4 = 1) u USING (book_id, segment_id)""",
    "state",
)
def stamped_audio(spark, sf):
    """Audio records of every fourth segment, replaced or added, with the time of the change."""
    old = lib.state(spark, sf).select("book_id", "segment_id", "status", F.lit(None).cast("string").alias("updated_at"))
    new = lib.segments(spark, sf).where("order_in_file % 4 = 1").select("book_id", "segment_id", F.lit("completed").alias("status"))
    return st.stamped(old, new, F.lit("2020-01-02 03:04:05"))


@query(
    _chapter_sql(
        f"""SELECT book_id, chapter_file, md5(string_agg('file ''' || segment_id || '.m4a''', chr(10) ORDER BY spine_index, order_in_file)) AS lines_md5
 FROM segments JOIN (SELECT book_id, file_path, chapter_file FROM ({AUDIO})) USING (book_id, file_path) JOIN state t USING (book_id, segment_id) WHERE t.status = 'completed' GROUP BY book_id, chapter_file""",
        "state",
    )
)
def concat_lists(spark, sf):
    """What joins the audio files of each chapter, in reading order."""
    rows = lib.segments(spark, sf)
    done = lib.state(spark, sf).where("status = 'completed'").select("book_id", "segment_id", "status", F.concat("segment_id", F.lit(".m4a")).alias("audio_path"), F.lit(1.0).alias("duration_seconds"))
    plan = audio.assembly(rows, chapters.audio_chapter_of(lib.spine(spark, sf), lib.toc(spark, sf)), done)
    return audio.concat_lists(plan).select("book_id", "chapter_file", F.md5("lines").alias("lines_md5"))


@query(
    "SELECT book_id, segment_id, t.status, source_content FROM segments LEFT JOIN state t USING (book_id, segment_id) WHERE doc_id = 30 AND order_in_file = 1", "state"
)
def segment_lookup(spark, sf):
    """One segment with its record, by its id."""
    wanted = lib.segments(spark, sf).where("doc_id = 30 and order_in_file = 1").select("segment_id")
    return export.lookup(lib.segments(spark, sf), lib.state(spark, sf), wanted).select("book_id", "segment_id", "status", "source_content")


@query("SELECT 'en-US' AS locale, 'A' || o_orderkey AS short_name FROM orders WHERE o_orderkey % 3 = 0")
def voice_list(spark, sf):
    """Voices of a locale's prefix, whatever its case."""
    locale = F.element_at(F.array(F.lit("en-US"), F.lit("de-DE"), F.lit("fr-FR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return audio.voices(table(spark, sf, "orders").select(locale.alias("locale"), F.concat(F.lit("A"), "o_orderkey").alias("short_name")), "EN")


#: The tokens of documents by language, with their final full stop told apart.
WORDS_SQL = """t AS (SELECT lang, trim(lower(unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'))), '"''“”‘’«»()[]{},;:!?…') AS token FROM documents),
w AS (SELECT lang, CASE WHEN ends_with(token, '.') THEN left(token, length(token) - 1) ELSE token END AS word, CASE WHEN ends_with(token, '.') THEN 1 ELSE 0 END AS dot FROM t),
c AS (SELECT lang, word, CAST(sum(dot) AS BIGINT) AS dotted, CAST(sum(1 - dot) AS BIGINT) AS bare FROM w
 WHERE word <> '' AND NOT ends_with(word, '.') AND regexp_matches(word, '\\p{L}') GROUP BY lang, word)"""


@query(f"WITH {WORDS_SQL} SELECT * FROM c")
def abbreviation_counts(spark, sf):
    """How often each word of a language stands with a final full stop, and without."""
    return abbreviations.counts(table(spark, sf, "documents"))


@query(
    f"""WITH {WORDS_SQL}, a AS (SELECT lang, sum(dotted)::DOUBLE / sum(dotted + bare) AS p FROM c GROUP BY lang),
s AS (SELECT lang, word, length(replace(word, '.', '')) AS k, length(word) - length(replace(word, '.', '')) AS d,
 -2 * (dotted * ln(p) + bare * ln(1 - p) - dotted * ln(0.99) - bare * ln(1 - 0.99)) AS ratio, bare FROM c JOIN a USING (lang) WHERE dotted > 0 AND p < 1)
SELECT lang, word FROM s WHERE ratio * exp(-k) * (d + 1) * pow(k::DOUBLE, -bare::DOUBLE) >= 0.3"""
)
def learned_abbreviations(spark, sf):
    """The abbreviations of each language, by the ratio of likelihoods."""
    return abbreviations.learned(abbreviations.counts(table(spark, sf, "documents"))).select("lang", "word")
