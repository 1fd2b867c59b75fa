"""Titles cut inside character references, at every place, against each query's SQL."""

import html

import duckdb
import pytest

from quire.plans.queries import QUERIES, SQL

TEXT = 'Salt && Pepper, token = "9c44caf4" & more'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cut"))
    whole = html.escape(TEXT)
    titles = [whole[:n] for n in range(4, len(whole) + 1)] + ["It is &copy", "1 &lt", "a &nbsp b"]
    pages = [
        (i, f"http://a.org/en/{i}", f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{t}</title><style>p{{margin:0}}</style><script>track({i});</script></head>'
         f'<body><nav><ul><li><a href="/one">one</a></li><li><a href="/two">two</a></li></ul></nav><!-- ad {i} --><div class="ad">An advert.</div>'
         f"<article><h1>{t}</h1><p>{whole}</p><p>{t}</p></article><footer>&copy; a.org &middot; End.</footer></body></html>")
        for i, t in enumerate(titles)
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize(
    "name",
    ["cleaned_pages", "document_titles", "translated_headings", "translated_segments", "page_markdown", "page_previews", "page_segments", "page_speech", "page_titles"],
)
def test_cut_references_stay_as_in_the_sql(spark, folder, name):
    found = QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
