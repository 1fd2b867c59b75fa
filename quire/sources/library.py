"""A library of books seen in the standard tables.

A source of ``documents`` is a book, each of its documents a spine item, each line a paragraph; a
third of the documents are entries of the table of contents; ``labels`` decide the state of segments.
Each view has the same definition in SQL in ``VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions.text import collapse, dots, not_blank, segment_id, stem
from quire.operators.numbering import numbered

TITLES = (
    "Cover", "Index of things", "Notes", "Chapter", "Discovery", "Bibliography", "Part Two", "Preface", "About the Author", "", "Further Reading",
)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang"), ["source"], "doc_id", 0)
    return docs.select(
        F.col("source").alias("book_id"),
        "doc_id",
        F.concat(F.lit("Text/doc_"), F.col("doc_id"), F.lit(".xhtml")).alias("file_path"),
        F.col("nth").cast("long").alias("spine_index"),
        "lang",
        (F.col("doc_id") % 17 != 0).alias("linear"),
    )


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third spine item is an entry, so its position follows from its index."""
    named = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    chosen = spine(spark, sf_dir).where("spine_index % 3 = 1")
    return chosen.select("book_id", F.expr("spine_index div 3").alias("pos"), named.alias("title"), F.concat("file_path", F.lit("#top")).alias("href"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.where(not_blank(F.col("raw"))).select("doc_id", "line", dots(collapse(F.col("raw"))).alias("source_content"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    lines = lines.withColumn("order_in_file", order.cast("long")).withColumn("xpath", F.concat(F.lit("/html/body/p["), F.col("line") + 1, F.lit("]")))
    full = lines.join(spine(spark, sf_dir), "doc_id")
    kind = F.when(F.col("order_in_file") == 1, "h1").otherwise("p")
    return full.select(
        "book_id", segment_id(stem(F.col("file_path")), F.col("xpath")).alias("segment_id"), "doc_id", "file_path", "spine_index", "order_in_file", "xpath",
        kind.alias("element_type"), F.lit("text").alias("extract_mode"), "source_content",
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for the segments of labelled documents, and one orphan for every hundredth label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    full = segments(spark, sf_dir).join(labels, "doc_id")
    n = F.col("order_in_file")
    status = F.when((F.col("toxic") == 1) & (n % 5 == 0), "skipped").when(F.col("quality") == 0, "error").otherwise("completed")
    answer = F.when(n % 7 == 3, F.lit("I'm sorry, I can't help with that.")).otherwise(F.concat(F.lit("T: "), F.col("source_content")))
    real = full.select(
        "book_id", "segment_id", status.alias("status"), F.when(status == "completed", answer).alias("translation"),
        F.when(n % 4 != 0, F.lit("stub")).alias("provider_name"), F.when(status == "error", F.lit("failed")).alias("error_message"),
    )
    lost = labels.where("doc_id % 100 = 0").select(
        F.lit("src0").alias("book_id"), F.concat(F.lit("lost-"), F.col("doc_id")).alias("segment_id"), F.lit("completed").alias("status"),
        F.lit("x").alias("translation"), F.lit("stub").alias("provider_name"), F.lit(None).cast("string").alias("error_message"),
    )
    return real.unionByName(lost)


#: The same views in SQL.
VIEWS = {
    "spine": """SELECT source AS book_id, doc_id, 'Text/doc_' || doc_id || '.xhtml' AS file_path,
 CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS spine_index, lang, doc_id % 17 <> 0 AS linear FROM documents""",
    "toc": """SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_index) - 1 AS BIGINT) AS pos,
 ([%s])[CAST(doc_id %% 11 AS INT) + 1] AS title, file_path || '#top' AS href FROM spine WHERE spine_index %% 3 = 1"""
    % ", ".join(f"'{t}'" for t in TITLES),
    "lines": """SELECT doc_id, line, regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '\\.\\s+\\.\\s+\\.(\\s+\\.)*', '...', 'g'),
 '\\.\\.\\.\\s*([^\\s])', '... \\1', 'g') AS source_content
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)""",
    "segments": """SELECT book_id, 'doc_' || doc_id || '-' || substr(sha1('/html/body/p[' || line || ']'), 1, 12) AS segment_id, doc_id, file_path, spine_index,
 order_in_file, '/html/body/p[' || line || ']' AS xpath, CASE WHEN order_in_file = 1 THEN 'h1' ELSE 'p' END AS element_type, 'text' AS extract_mode, source_content
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS order_in_file FROM lines WHERE source_content <> '') JOIN spine USING (doc_id)""",
    "state": """SELECT book_id, segment_id, status, CASE WHEN status = 'completed' THEN
   CASE WHEN n % 7 = 3 THEN 'I''m sorry, I can''t help with that.' ELSE 'T: ' || source_content END END AS translation,
 CASE WHEN n % 4 <> 0 THEN 'stub' END AS provider_name, CASE WHEN status = 'error' THEN 'failed' END AS error_message
 FROM (SELECT book_id, segment_id, source_content, order_in_file AS n,
   CASE WHEN toxic = 1 AND order_in_file % 5 = 0 THEN 'skipped' WHEN quality = 0 THEN 'error' ELSE 'completed' END AS status FROM segments JOIN labels USING (doc_id))
 UNION ALL SELECT 'src0', 'lost-' || doc_id, 'completed', 'x', 'stub', NULL FROM labels WHERE doc_id % 100 = 0""",
}


def with_views(query: str, *names: str) -> str:
    """A query over views of the library, as one statement."""
    needs = {"toc": {"spine"}, "segments": {"spine", "lines"}, "state": {"spine", "lines", "segments"}}
    wanted = set(names)
    for n in names:
        wanted |= needs.get(n, set())
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted) + "\n" + query
