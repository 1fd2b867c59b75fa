"""The thin queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import ann, bpe, divergence, htmltext, langid, ngramjoin, packing, quality, repeats, sharding, simhash, turns, urlfilter
from quire.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 8,192 bytes; documents that agree but for case are one duplicate cluster."""
    cluster = F.xxhash64(F.lower("text"))
    return packing.pack(_table(spark, sf_dir, "documents"), cluster)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is that of the document it shows, whose label is the page's outcome: bad if
    its quality is 0 or it is toxic.
    """
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), bad.alias("bad"))
    shown = F.regexp_extract("path", r"^/[^/]*/([0-9]{1,18})", 1)
    key = F.when(shown != "", shown).cast("long")
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), outcomes, key).select("page_id", "host", "path", "rule", "verdict")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    stats = Scratch(spark, "quality").put(quality.statistics(docs), "stats")
    rules = quality.learn(stats, labels)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return stats.select("doc_id", *own, quality.base_failed().alias("base_failed"), quality.verdict(rules).alias("kept"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_minimax_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    parser = langid.train(docs.where(remainder != 0))
    found = langid.identify(docs, parser)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_tag_path_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op11_count_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return turns.repair(turns.damaged(rows), rows.select("conv_id").distinct())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_run_length_index,
        op2_conflict_best_fit,
        op3_host_reputation,
        op4_decision_list,
        op5_chunked_bpe,
        op6_minimax_partition,
        op7_cross_parsing,
        op8_dimension_scan,
        op9_segment_popcount,
        op10_tag_path_ratio,
        op11_count_vector_tree,
        op12_source_divergence,
        op13_cost_layers,
    )
    return {f.__name__: f for f in found}


def _strength_sql(level: str) -> str:
    """The prior's strength of a level by moments, as urlfilter has it."""
    return f"""(SELECT greatest({urlfilter.WEAKEST}, least({urlfilter.STRONGEST}, CASE WHEN b IS NULL OR q / t - p * p <= p * (1 - p) * u / t THEN {urlfilter.STRONGEST}
 ELSE (p * (1 - p) - (q / t - p * p)) / ((q / t - p * p) - p * (1 - p) * u / t) END)) AS k FROM (SELECT *, b / t AS p FROM (
 SELECT sum(bad) AS b, CAST(sum(n) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS u, sum(bad * bad / n) AS q FROM {level} WHERE n > 0)))"""


def _rule_sql(value: str) -> str:
    cases = []
    for rule, said in sorted(urlfilter.RULES, key=lambda r: (-len(r[0]), r[0])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        then = rule if value == "rule" else said
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}') THEN '{then}'")
    return "CASE " + " ".join(cases) + " END"


OP3_SQL = f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT host, CASE WHEN array_to_string(x[-2:], '.') IN {urlfilter.TWO_LABELS} THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain,
 CASE WHEN array_to_string(x[-2:], '.') IN {urlfilter.TWO_LABELS} THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix FROM (SELECT DISTINCT host, string_split(host, '.') AS x FROM p)),
hosts AS (SELECT host, domain, suffix, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n FROM named LEFT JOIN (
 SELECT host, CAST(sum(greatest(1 - quality, toxic)) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS n FROM p JOIN labels
 ON doc_id = TRY_CAST(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') AS BIGINT) WHERE coalesce(quality, toxic) IS NOT NULL GROUP BY host) USING (host)),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix),
s AS (SELECT suffix, (bad + k * (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM suffixes)) / (n + k) AS m FROM suffixes, {_strength_sql("suffixes")}),
d AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM domains JOIN s USING (suffix), {_strength_sql("domains")}),
h AS (SELECT host, (bad + k * m) / (n + k) AS m, n + k AS t FROM hosts JOIN d USING (domain), {_strength_sql("hosts")})
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (t + 1)) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
 FROM p JOIN h USING (host)"""


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM e GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
 LEFT JOIN (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v)::HUGEINT AS p,
 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v)::HUGEINT AS q FROM g JOIN k USING (lang) JOIN v USING (lang)
 LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f FROM dense a JOIN dense b USING (lang, term) GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force."""
    return {"op3_host_reputation": OP3_SQL, "op12_source_divergence": OP12_SQL}
