from pyspark.sql import functions as F

from quire.operators import web


def test_titles_are_escaped_and_json_stays(spark):
    page = spark.range(1).select(web.start_page(F.lit("A <b> & \"c\" 'd'"), F.lit('{"toc": []}'))).first()[0]
    assert "<title>A &lt;b&gt; &amp; &quot;c&quot; &#x27;d&#x27;</title>" in page and '<script type="application/json" id="book">{"toc": []}</script>' in page
