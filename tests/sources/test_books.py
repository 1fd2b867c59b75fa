import io
import zipfile

import pytest

from quire.sources import epub, files, sinks

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Test Book</dc:title><dc:creator>A. B.</dc:creator></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="t" href="text.html" media-type="application/xhtml+xml"/>
<item id="i" href="img/cover.png" media-type="image/png"/><item id="j" href="x/cover.png" media-type="image/png"/></manifest><spine toc="ncx"><itemref idref="gone"/><itemref idref="t" linear="no"/></spine></package>"""
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="text.html#a"/><navPoint><navLabel><text>In</text></navLabel><content src="text.html#b"/></navPoint></navPoint></navMap></ncx>'
PARTS = [
    ("mimetype", b"application/epub+zip"), ("META-INF/container.xml", CONTAINER.encode()), ("OEBPS/content.opf", OPF.encode()), ("OEBPS/toc.ncx", NCX.encode()),
    ("OEBPS/text.html", b"<html><body><h1>T</h1><p>x</p></body></html>"), ("OEBPS/img/cover.png", b"png"), ("OEBPS/x/cover.png", b"png2"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "sub").mkdir()
    for name in ("a.epub", "sub/b.epub"):
        (at / name).write_bytes(epub.written(PARTS, {}))
    return str(at)


def test_both_readers(spark, folder):
    epub.register(spark)
    rows = spark.read.format("epub").load(folder)
    assert rows.count() == 14 and epub.members(spark, f"file://{folder}").count() == 14
    assert spark.read.format("epub").option("limit", 1).load(folder).select("book_id").distinct().count() == 1


def test_package(spark, folder, tmp_path):
    found = epub.members(spark, f"file://{folder}")
    package = epub.packages(found)
    row = package.first()
    assert [(s["spine_index"], s["file_path"], s["linear"]) for s in row["spine"]] == [(1, "OEBPS/text.html", False)]
    assert [(t["pos"], t["level"], t["title"], t["href"]) for t in row["toc"]] == [(0, 0, "One", "OEBPS/text.html#a"), (1, 1, "In", "OEBPS/text.html#b")]
    assert {m["key"]: m["value"] for m in row["metadata"]} == {"title": "Test Book", "creator": "A. B."}
    docs = epub.spine_documents(found, package).collect()
    assert len(docs) == 2 and docs[0]["html"].startswith("<html>")
    assert sorted(r["name"] for r in epub.images(package).collect()) == ["cover.png", "cover.png", "cover_2.png", "cover_2.png"]
    new = epub.spine_documents(found, package).selectExpr("book_id", "file_path", "'<html>new</html>' as html")
    made = epub.book_members(found, new)
    sinks.write_archives(made.selectExpr("concat(regexp_extract(book_id, '[^/]*$', 0), '.zip') as path", "member", "content"), str(tmp_path))
    whole = (tmp_path / "a.epub.zip").read_bytes()
    names = zipfile.ZipFile(io.BytesIO(whole)).namelist()
    assert names[0] == "mimetype" and dict(epub.read_members(whole))["OEBPS/text.html"] == b"<html>new</html>"


def test_unsafe_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        epub.read_members(out.getvalue())
    assert not epub.safe_member("/x") and not epub.safe_member("C:\\x") and epub.safe_member("a/b..c")


def test_oversize_and_overfull_books_fail(spark, folder, monkeypatch):
    monkeypatch.setattr(epub, "MAX_BYTES", 100)
    with pytest.raises(Exception, match="larger than 100 bytes"):
        epub.members(spark, f"file://{folder}").collect()
    monkeypatch.setattr(epub, "MOST_UNPACKED", 100)
    with pytest.raises(ValueError, match="unpacks to more"):
        epub.read_members(epub.written(PARTS, {}))


def test_members_come_in_parts():
    parts = list(epub.member_parts(epub.written(PARTS, {}), most=300))
    assert len(parts) > 2 and [n for p in parts for n, _ in p] == [n for n, _ in PARTS]


def test_manifest_items(spark, folder):
    package = epub.packages(epub.members(spark, f"file://{folder}"))
    assert {r["media_type"] for r in epub.item(package, "OEBPS/img/cover.png").collect()} == {"image/png"}
    with pytest.raises(Exception, match="no OEBPS/none in"):
        epub.item(package, "OEBPS/none").collect()


def test_state_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([("b", "s", "completed", "x", "p", None, None)], files.STATE_SCHEMA)
    path = files.write_state(rows, str(tmp_path / "state"), 1)
    assert files.read_state(spark, path).collect() == rows.collect()
    (tmp_path / "c.yaml").write_text("target_language: German\nodd: 1\n")
    got, unknown = files.settings([str(tmp_path / "c.yaml"), {"translation_workers": 5}], {"QUIRE_TRANSLATION_WORKERS": "7"})
    assert got["target_language"] == "German" and got["translation_workers"] == 7 and unknown == ["odd"]
    files.write_chapters(str(tmp_path / "ch.yaml"), [{"title": "A", "start": "1:23:45"}, {"title": "B", "start": 45.5}], {"x": None, "y": 1})
    assert files.read_chapters(str(tmp_path / "ch.yaml")) == ([{"title": "A", "start": 5025.0}, {"title": "B", "start": 45.5}], {"y": 1})
    chapters = spark.createDataFrame([("b", 0, "A", "x"), ("b", 1, "B", "y")], "book_id string, position int, title string, body string")
    assert files.combined_markdown(chapters).first()["text"] == "# A\n\nx\n\n---\n\n# B\n\ny"
    files.write_markdown(chapters, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).count() == 2


NAV = """<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x.html">X</a></li></ol></nav>
<nav epub:type="toc"><h1>Contents</h1><ol><li><a href="ch%201.xhtml">First &amp; more</a><ol><li><a href="ch%201.xhtml#s%31">Inner</a></li></ol></li>
<li><span>Part</span><ol><li><a href="sub/two.xhtml">Second</a></li></ol></li></ol></nav></body></html>"""
OPF3 = """<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>
<item id="a" href="ch%201.xhtml" media-type="application/xhtml+xml"/><item id="b" href="sub/two.xhtml" media-type="application/xhtml+xml"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""


def test_escaped_names_navigation_and_encodings(spark, tmp_path):
    """A book whose hrefs are escaped, whose contents are a navigation document, whose documents aren't UTF-8."""
    pages = {
        "OEBPS/ch 1.xhtml": '<?xml version="1.0" encoding="UTF-16"?><p>Größe ż</p>'.encode("utf-16"),
        "OEBPS/sub/two.xhtml": '<?xml version="1.0" encoding="ISO-8859-1"?><p>café “x”</p>'.encode("cp1252"),
    }
    parts = [PARTS[0], PARTS[1], ("OEBPS/content.opf", OPF3.encode()), ("OEBPS/nav.xhtml", NAV.encode()), *pages.items()]
    (tmp_path / "a.epub").write_bytes(epub.written(parts, {}))
    found = epub.members(spark, f"file://{tmp_path}")
    package = epub.packages(found)
    assert [(t["level"], t["title"], t["href"]) for t in package.first()["toc"]] == [
        (0, "First & more", "OEBPS/ch 1.xhtml"), (1, "Inner", "OEBPS/ch 1.xhtml#s%31"), (0, "Part", ""), (1, "Second", "OEBPS/sub/two.xhtml"),
    ]
    got = {r["file_path"]: r["html"] for r in epub.spine_documents(found, package).collect()}
    assert got["OEBPS/ch 1.xhtml"].endswith("<p>Größe ż</p>") and got["OEBPS/sub/two.xhtml"].endswith("<p>café “x”</p>")


@pytest.mark.parametrize("raw, want", [
    (b"\xef\xbb\xbf<p>\xc3\xa9</p>", "<p>é</p>"), ("<p>é</p>".encode("utf-32"), "<p>é</p>"), (b"<p>\xe9</p>", "<p>é</p>"), (b"<p>\xc3\xa9</p>", "<p>é</p>"),
    (b'<meta charset="shift_jis"><p>\x82\xa0</p>', '<meta charset="shift_jis"><p>あ</p>'), (b'<?xml version="1.0" encoding="none-such"?>\xe9', '<?xml version="1.0" encoding="none-such"?>é'),
    (b'<?xml version="1.0" encoding="utf-8"?>\xff.', '<?xml version="1.0" encoding="utf-8"?>�.'), (b'<?xml encoding="utf-16"?>\xc3\xa9', '<?xml encoding="utf-16"?>é'),
    ("<?xml ?>é".encode("utf-16-le"), "<?xml ?>é"), (b"", ""),
])
def test_encodings(raw, want):
    assert epub.decoded(raw) == want


def test_contents_are_retitled_and_styled(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub.written([*PARTS, ("OEBPS/b.css", b"p {}"), ("OEBPS/a.css", b"q {}")], {}))
    found = epub.members(spark, f"file://{tmp_path}")
    book = found.first()["book_id"]
    titles = spark.createDataFrame([(book, "OEBPS/text.html", "a", "Eins"), (book, "OEBPS/text.html", None, "Datei")], "book_id string, file_path string, fragment string, title string")
    none = spark.createDataFrame([], "book_id string, file_path string, html string")
    for given, want in ((titles, ["Eins", "Datei"]), (titles.limit(0), ["One", "In"]), (None, ["One", "In"])):
        made = {r["member"]: bytes(r["content"]) for r in epub.book_members(found, none, given, True).collect()}
        assert len(made) == len(PARTS) + 2 and epub.ONLY_CSS.encode() in made["OEBPS/a.css"] and made["OEBPS/b.css"] == b"p {}"
        assert [t["title"] for t in epub.ncx_entries(made["OEBPS/toc.ncx"], "OEBPS")] == want
