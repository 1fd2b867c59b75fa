import re

from pyspark.sql import functions as F

from quire.llm import urlfilter

URLS = [
    ("http://A.Net/x", "a.net", "/x", "net/"),
    ("http://a.net", "a.net", "", None),
    ("https://www.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/"),
    ("https://badexample.net/en/", "badexample.net", "/en/", "net/"),
    ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/"),
    ("http://example.com/de", "example.com", "/de", None),
    ("http://x.org/fr/a?b=/fr/", "x.org", "/fr/a", "org/fr/"),
    ("http://x.org?y/z", "x.org", "", None),
    ("a?b://c.net/d", "c.net", "/d", "net/"),
    ("http://É.net/\nq", "É.net", "/\nq", "net/"),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("x:///p", "", "/p", None),
]


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "key long, bad int")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, none).collect()}
    said = dict(urlfilter.RULES)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), URLS[i]
        assert got[i]["verdict"] == said.get(rule, "allow")
    assert urlfilter.filter_urls(df.where("page_id > 99"), none).count() == 0


def test_posteriors(spark):
    hosts = {"bad.a.com": (30, 30), "good.a.com": (0, 30), "few.a.com": (2, 2), "x.b.org": (1, 40), "none.b.org": (0, 0)}
    pages, labels, n = [], [], 0
    for host, (bad, labelled) in hosts.items():
        for i in range(labelled + 3):
            pages.append((n, f"http://{host}/{i}"))
            if i < labelled:
                labels.append((n, int(i < bad)))
            n += 1
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = spark.createDataFrame([*labels, (None, 1), (3, None)], "key long, bad int")
    got = {r["host"]: r for r in urlfilter.filter_urls(df, out).collect()}
    assert {h: r["verdict"] for h, r in got.items()}["bad.a.com"] == "block"
    assert all(got[h]["verdict"] == "allow" for h in ("good.a.com", "x.b.org", "none.b.org"))
    assert got["good.a.com"]["mean"] < got["few.a.com"]["mean"] < got["bad.a.com"]["mean"]
    assert got["none.b.org"]["mean"] < 0.35 and all(re.match(r"[a-z.]+$", h) for h in got)
