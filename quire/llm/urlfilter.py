"""URL filters: longest-rule matching, and host reputations by empirical Bayes where no rule fits.

Labelled page outcomes (bad or not) are counted for each host, each registered domain (a suffix and one more
label) and each public suffix (the last label, or one of ``TWO_LABELS``). A beta-binomial prior is estimated at every
level by moments (how much the units of that level vary beyond what their sizes explain), and
posteriors are shrunk from the whole to the suffix, to the domain, to the host. A host is blocked
if even the lower bound of its posterior, ``z`` standard deviations under the mean, exceeds
``threshold``, the share of bad pages that is put up with; hosts without labelled pages take their domain's posterior mean as their prior.

Only DataFrame operations are used. Page rows meet the verdicts in joins that Spark can split, so a
host may hold any share of the rows; counts are pre-aggregated before they are shuffled.

Edge cases: null urls and those without ``://`` have empty host and path, match no rule, and form
one host with no domain; pages without label count as no evidence; a page id with several labels
counts each; without any label everything is allowed. Repeated rows keep a row each; urls of any length are read whole; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import Scratch

#: (rule, verdict); a rule is a host, then a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Public suffixes of two labels that are told from registered domains; fixed values.
TWO_LABELS = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz",
    "govt.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "ac.za", "co.za", "gov.za", "org.za", "co.in",
    "gov.in", "net.in", "org.in", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.mx", "gob.mx", "org.mx", "com.tr",
    "gov.tr", "org.tr", "com.ar", "com.sg", "com.hk", "com.tw", "co.il", "co.th", "co.id",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Strength of a prior where the units of a level don't differ, or differ without limit.
STRONGEST, WEAKEST = 1000.0, 1.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where they are one of ``TWO_LABELS``."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one more label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def _strengths(hosts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """{level: (bad, n, strength)} by moments over the units of each level with labels; one aggregate, a row a level."""
    seen = hosts.where("n > 0")
    levels = [seen.select(F.lit("host").alias("level"), F.col("host").alias("unit"), "bad", "n")]
    for level in ("domain", "suffix"):
        levels.append(seen.groupBy(F.col(level).alias("unit")).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).select(F.lit(level).alias("level"), "unit", "bad", "n"))
    units = levels[0].union(levels[1]).union(levels[2])
    total = units.groupBy("level").agg(
        F.sum("bad").alias("b"), F.sum("n").cast("double").alias("t"), F.count("*").cast("double").alias("u"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q")
    )
    out = {}
    for r in total.collect():
        p = r["b"] / r["t"]
        spread, noise = r["q"] / r["t"] - p * p, p * (1 - p) * r["u"] / r["t"]
        k = STRONGEST if spread <= noise else (p * (1 - p) - spread) / (spread - noise)
        out[r["level"]] = (r["b"], r["t"], max(WEAKEST, min(STRONGEST, k)))
    return out


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, mean, lower) for every host of ``pages(key, host)``; ``outcomes(key, bad)``.

    ``bad`` is 0 or 1. A page without an outcome counts as no evidence, one with several counts each. Pages are
    read once: the counts of the hosts are written before anything else is derived from them. Three numbers a level go to the driver.
    """
    told = outcomes.where("key is not null and bad is not null").select("key", F.col("bad").cast("double").alias("bad"))
    hosts = pages.join(told, "key", "left").groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("bad").alias("n"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = Scratch(pages.sparkSession, "hosts").put(hosts, "hosts")
    strength = _strengths(hosts)
    b, n, k_suffix = strength.get("suffix", (0.0, 0.0, STRONGEST))
    k_domain, k_host = (strength.get(x, (0.0, 0.0, STRONGEST))[2] for x in ("domain", "host"))
    prior = F.lit(b / n if n else 0.0)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    s = suffixes.select("suffix", ((F.col("bad") + k_suffix * prior) / (F.col("n") + k_suffix)).alias("m_suffix"))
    d = domains.join(s, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("m_suffix")) / (F.col("n") + k_domain)).alias("m_domain"))
    h = hosts.join(d, "domain").select(
        "host", (F.col("bad") + k_host * F.col("m_domain")).alias("a"), (F.col("n") + F.lit(k_host)).alias("t")
    )
    mean = F.col("a") / F.col("t")
    deviation = F.sqrt(mean * (1 - mean) / (F.col("t") + 1))
    return h.select("host", mean.alias("mean"), (mean - z * deviation).alias("lower"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, key: Column | None = None, threshold: float = 0.25, z: float = 1.645, rules=RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, lower) for every row.

    ``key``: the page's key in ``outcomes``, over the columns page_id, host and path; by default page_id.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputations(parts.select((F.col("page_id") if key is None else key).alias("key"), "host"), outcomes, z)
    joined = parts.join(known, "host")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    for name, said in rules:
        verdict = F.when(F.col("rule") == name, F.lit(said)).otherwise(verdict)
    return joined.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mean", "lower")
