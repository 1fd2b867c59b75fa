import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions.html import Paths, parse
from quire.operators import segments, web


def shapes(source):
    return [(tag, content) for _, _, content, tag in segments.document_segments(source)]


def test_simple_page():
    got = shapes("<html><body><h1>Chapter One</h1><p>Text.</p><div>Inline <em>em</em></div><ul><li><span class=x>a</span></li><li>b</li></ul></body></html>")
    assert [t for t, _ in got] == ["h1", "p", "div", "ul"] and got[0][1] == "Chapter One" and "<span" not in got[3][1]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p><span>T</span><span>he</span> fantasy always runs like this.</p>", [("p", "The fantasy always runs like this.")]),
        ("<blockquote><blockquote><blockquote>in</blockquote></blockquote></blockquote>", [("blockquote", "in")]),
        ("<blockquote>own<blockquote>child</blockquote></blockquote>", [("blockquote", "ownchild"), ("blockquote", "child")]),
        ("<div><div>x</div></div>", [("div", "x")]),
        ("<table><tr><td><p>in</p></td></tr></table>", [("table", "<tr><td><p>in</p></td></tr>")]),
        ("<p> </p><p>a</p><p></p><p>b . . . c</p>", [("p", "a"), ("p", "b ... c")]),
        ("<figure><img src='a.png' class=c><span>t</span></figure>", [("figure", '<img src="a.png">t')]),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", [("ul", "<li>a<ul><li>b</li></ul></li>")]),
    ],
)
def test_rules(source, want):
    assert shapes(source) == want


def test_paths_round_trip():
    root = parse("<html><body><p>a</p><div><p>b</p><p>c</p></div></body></html>")
    for node in root.walk():
        if node.parent is not None:
            assert Paths(root).find(Paths(root).of(node)) is node
    assert Paths(root).find("/html/body/p[2]") is None


def test_ids_and_order(spark):
    page = "<html><body><p>one</p><p>two</p></body></html>"
    rows = [("b", "a/ch1.xhtml", 0, page), ("b", "c/ch1.xhtml", 1, page), ("b", "ch2.xhtml", 2, page), ("b", "e.xhtml", 3, None)]
    df = segments.segment_documents(spark.createDataFrame(rows, "book_id string, file_path string, spine_index int, html string"))
    got = segments.unique_ids(df).orderBy("spine_index", "order_in_file").collect()
    assert len({r["segment_id"] for r in got}) == 6 and [r["order_in_file"] for r in got] == [1, 2] * 3
    assert df.select("segment_id").distinct().count() == 4


def test_injection():
    source = "<html><body><p>one</p><p class='k'>two</p><ul><li>x</li></ul></body></html>"
    items = [
        {"segment_id": str(i), "xpath": x, "extract_mode": m, "translation": t, "order_in_file": i}
        for i, (x, m, t) in enumerate([("/html/body/p[1]", "text", "1 & 1"), ("/html/body/p[2]", "text", "2"), ("/html/body/ul", "html", "<li>y</li>"), ("/html/body/p[9]", "text", "z")])
    ]
    both, lost = segments.injected(source, items)
    assert lost == ["3"] and both.count("<p") == 4 and "<li>x</li>" in both and "<li>y</li>" in both and "1 &amp; 1" in both
    only, _ = segments.injected(source, items, "translated_only")
    assert only == '<html><body><p>1 &amp; 1</p><p class="k">2</p><ul><li>y</li></ul></body></html>'


def test_speech():
    assert segments.spoken_markup("<li>one</li><li>two!</li><li><b>three</b></li>", "ul").replace(" ", "") == "one.two!three."
    assert segments.spoken_markup("a<a href='#fn1'><sup>1</sup></a> b<a href='x.html'><sup>2</sup></a>", "p") == "a b2"
    link = parse("<a class='footnote' href='x'><sup>1</sup></a>").children[0]
    assert segments.note_reference(link) and not segments.note_reference(parse("<a href='formula.xhtml'><sup>2</sup></a>").children[0])
    assert segments.note_definition(parse("<aside epub:type='footnote'><p>x</p></aside>").children[0].children[0])
    assert not segments.note_definition(parse("<div id='banknote'><p>x</p></div>").children[0].children[0])


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("<a class='note' href='x.html'><sup>1</sup></a>", True),
        ("<a class='fn' href='x.html'><sup>1</sup></a>", True),
        ("<a id='note4' href='x.html'><sup>1</sup></a>", True),
        ("<a epub:type='noteref' href='x.html'><sup>1</sup></a>", True),
        ("<a role='doc-noteref' href='x.html'><sup>1</sup></a>", True),
        ("<a><sup>1</sup></a>", True),
        ("<a href='notes.xhtml#n1'><sup>1</sup></a>", True),
        ("<a href='formula.xhtml'><sup>2</sup></a>", False),
    ],
)
def test_note_references(link, want):
    assert segments.note_reference(parse(link).children[0]) == want


def test_speech_reads_the_document(spark):
    page = "<html><body><p>Text<a class='noteref' href='n.html'><sup>1</sup></a> goes on.</p><aside epub:type='footnote'><p>A note.</p></aside><ul><li>one</li></ul></body></html>"
    docs = spark.createDataFrame([("b", "a.xhtml", 0, page)], "book_id string, file_path string, spine_index int, html string")
    rows = segments.segment_documents(docs)
    got = {r["element_type"] + str(r["order_in_file"]): r["from_source"] for r in segments.spoken(rows, docs).collect()}
    assert got == {"p1": "Text goes on.", "p2": None, "ul3": "one."}


def test_deep_pages():
    page = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000
    assert [c for _, _, c, _ in segments.document_segments(page)] == ["in"]
    assert "in" in web.cleaned(page) and web.markdown(page) == "in"
    assert "in" in segments.injected(page, [{"segment_id": "s", "xpath": "/p", "extract_mode": "text", "translation": "x", "order_in_file": 1}])[0]


def test_list_stops():
    def stopped(source):
        root = parse(source)
        segments.with_list_stops(root)
        return [n.content().strip() for n in root.walk() if n.tag == "li"]

    assert stopped("<ul><li>a<li>b!<li> <li><b>c</b> d</ul>") == ["a.", "b!", "", "c d."]
    assert stopped("<ul><li><i>e</i></ul>") == ["e."] and stopped("<ul><li><i>f.</i></ul>") == ["f."]


def test_injection_keeps_head_and_body():
    page = "<html><head lang='x'><title>t</title></head><body class='k'><p>a</p></body></html>"
    item = {"segment_id": "s", "xpath": "/html/body/p", "extract_mode": "text", "translation": "b", "order_in_file": 1}
    got, _ = segments.injected(page, [item], "translated_only")
    assert got == '<html><head lang="x"><title>t</title></head><body class="k"><p>b</p></body></html>'


def test_titles_and_images(spark):
    assert segments.document_title("<title>T</title><h1> a <b>b</b></h1><h1>c</h1>") == "a b"
    assert segments.document_title("<title>T</title><h1> </h1>") == "T" and segments.document_title("<p>x") is None
    rows = [("b", "t/a.xhtml", 1, "<svg><image xlink:href='../i/x.png'/></svg><img src='http://x/y.png'><img src='y.png'>"), ("b", "t/b.xhtml", 0, None)]
    docs = spark.createDataFrame(rows, "book_id string, file_path string, spine_index int, html string")
    assert [tuple(r)[1:] for r in segments.image_references(docs).orderBy("pos").collect()] == [(1, 0, "i/x.png"), (1, 2, "t/y.png")]


def test_headings_and_missing_documents(spark):
    page = "<html><body><h1 id='one'>A</h1><section id='two'><h2>B <i id='three'>x</i></h2><p>y</p></section></body></html>"
    docs = spark.createDataFrame([("b", "f", 0, page)], "book_id string, file_path string, spine_index int, html string")
    rows = segments.segment_documents(docs).withColumn("translation", F.concat(F.lit("T"), "order_in_file"))
    got = {(r["fragment"], r["title"]) for r in segments.headings(rows, docs).collect()}
    assert got == {(None, "T2"), ("one", "T1"), ("two", "T2"), ("three", "T2")}
    lost = segments.missing_documents(docs.where("false"), rows).first()
    assert (lost["file_path"], lost["n"]) == ("f", 3)


def test_cleaning_and_markdown():
    got = web.cleaned("<p onclick='x' style='y' class='z'>a<script>bad()</script><a href='java\tscript:x'>l</a><font>f</font></p><img src='../i/a.png'>", "Text/c.xhtml")
    assert "script" not in got and "onclick" not in got and "style" not in got and "<font>" not in got and "f</p>" in got
    assert 'src="content/i/a.png"' in got and 'loading="lazy"' in got and "href" not in got
    assert 'href="content/Text/b.xhtml#x"' in web.cleaned("<a href='b.xhtml#x'>l</a>", "Text/a.xhtml")
    assert web.srcset("a.png 1x, b.png 2x") == ["a.png 1x", " b.png 2x"] and web.srcset("data:image/png;base64,x,y 1x, b 2x")[0] == "data:image/png;base64,x,y 1x"
    assert web.markdown("<h1>T</h1><p>a <em>b</em> <strong>c</strong></p><ul><li>x<li>y</ul><blockquote><p>q</p></blockquote>") == "# T\n\na _b_ **c**\n\n* x\n* y\n\n> q"
    assert web.markdown("<p><img src='../img/a.png' alt='A'></p>", "Text/c.xhtml", {"img/a.png": "a_2.png"}) == "![A](images/a_2.png)"


def test_wide_documents_take_linear_time():
    """A hundred thousand paragraphs: their paths, and translations behind all of them."""
    source = "<body>" + "".join(f"<p>n{i}</p>" for i in range(100_000)) + "</body>"
    began = time.perf_counter()
    found = list(segments.document_segments(source))
    items = [{"segment_id": str(i), "xpath": x, "extract_mode": m, "translation": c.upper(), "order_in_file": i} for i, (x, m, c, _) in enumerate(found)]
    page, lost = segments.injected(source, items)
    assert time.perf_counter() - began < 30 and not lost and len(found) == 100_000
    assert page.startswith('<body><p data-lang="original">n0</p><p data-lang="translation">N0</p><p data-lang="original">n1</p>') and page.count("<p ") == 200_000


def test_cleaning_keeps_references_that_were_cut_off():
    page = '<p title="&quo">a &quo<b>&copy; &cop &notit</b> R&D & Q &am &amp; &lt; <a href="/x?a=1&b=2">l</a></p>'
    want = '<p title="&quo">a &quo<b>© &cop ¬it</b> R&amp;D &amp; Q &amp;am &amp; &lt; <a href="/x?a=1&b=2">l</a></p>'
    assert web.cleaned(page) == want


def test_results_of_a_column_map_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(segments, "SLICE", 1000)
    html = "<p>" + "word " * 100 + "</p>"
    rows = spark.createDataFrame([(i, None if i == 7 else html, "x") for i in range(50)], "id int, html string, more string").coalesce(1)
    found = segments.column_map(rows, web.markdown, ["html"], "made", ["id"])
    assert found.columns == ["id", "made"] and {r["made"] is None for r in found.where("id = 7").collect()} == {True}
    assert segments.column_map(rows, web.markdown, ["html"], "html").columns == ["id", "html", "more"]
    batch = pa.RecordBatch.from_pydict({"html": [html] * 50 + [None]})
    assert max(p.num_rows for p in segments._pieces(batch, "html")) <= 2 and sum(p.num_rows for p in segments._pieces(batch, "html")) == 51


def test_tasks_hold_bounded_batches_of_markup(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    pages = spark.range(3000, numPartitions=1).select(
        F.lit("b").alias("book_id"), F.concat(F.lit("p"), "id").alias("file_path"), F.col("id").cast("int").alias("spine_index"), F.repeat(F.lit("word "), 2000).alias("html")
    )
    before = spark.conf.get(segments.BATCH)
    try:
        for made in (segments.segment_documents, segments.image_references, lambda x: segments.column_map(x, web.markdown, ["html"], "made")):
            spark.conf.set(segments.BATCH, before)
            made(pages)
            read = [r["n"] for r in pages.select("html").mapInArrow(sizes, "n bigint").collect()]
            assert sum(read) > 30_000_000 and max(read) < 2 * segments.BATCH_BYTES
    finally:
        spark.conf.set(segments.BATCH, before)


def test_references_that_were_cut_off_are_text():
    root = parse('<p title="&quot" href="/x?a=1&copy=2">a &quot</p><!-- &copy --><script>a &lt b</script><a&gt>x</a&gt> &quot; &amp &notit &quo')
    assert root.content() == 'a &quota &lt bx " & ¬it &quo' and root.children[0].attrs == {"title": "&quot", "href": "/x?a=1&copy=2"}
    assert root.inner().endswith('<!-- &copy --><script>a &lt b</script><a&gt>x</a&gt> " &amp; ¬it &amp;quo')
