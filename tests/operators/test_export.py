import json

import yaml

from quire.operators import export
from quire.sources import files


def test_covers(spark):
    images = spark.createDataFrame([("a", 0, "i/x.png"), ("a", 1, "i/Cover.png"), ("b", 0, "i/x.png"), ("c", 0, "i/x.png"), ("c", 1, "i/y.png"), ("d", 0, "i/c.png"), ("d", 1, "i/m.png")], "book_id string, pos int, file_path string")
    marked = spark.createDataFrame([("d", "i/m.png"), ("c", "gone.png")], "book_id string, file_path string")
    used = spark.createDataFrame([("c", 3, 0, "i/y.png"), ("c", 1, 0, "no.png"), ("d", 0, 0, "i/c.png")], "book_id string, spine_index int, pos int, file_path string")
    assert dict(r[:2] for r in export.covers(images, marked, used).collect()) == {"a": "i/Cover.png", "b": "i/x.png", "c": "i/y.png", "d": "i/m.png"}


def test_names_keys_metadata(spark):
    images = spark.createDataFrame([("b", i, p) for i, p in enumerate(["a/x.png", "b/x.png", "c/x", "d/x", "x.tar.gz"])], "book_id string, pos int, file_path string")
    assert [r["name"] for r in export.image_names(images).orderBy("file_path").collect()] == ["x.png", "x_2.png", "x", "x_2", "x.tar.gz"]
    members = spark.createDataFrame([("b", m) for m in ("mimetype", "META-INF/container.xml", "z/b.opf", "OEBPS/deep/a.opf", "z/A.opf", "z/t.ncx", "x.html")], "book_id string, member string")
    assert dict(tuple(r)[1:] for r in export.key_files(members).collect()) == {"mimetype": "mimetype", "container": "META-INF/container.xml", "opf": "z/A.opf", "ncx": "z/t.ncx"}
    package = spark.createDataFrame([("b", [("title", "T"), ("creator", "C"), ("title", "U"), ("date", "1999-01-02")])], "book_id string, metadata array<struct<key:string,value:string>>")
    assert tuple(export.metadata(package).first()) == ("b", "T", "C", None, "1999")


def test_book_json_and_titles(spark):
    books = spark.createDataFrame([("b", "</script>")], "book_id string, title string")
    spine = spark.createDataFrame([("b", 1, "content/b", "B"), ("b", 0, "content/a", "A & B")], "book_id string, spine_index int, href string, title string")
    toc = spark.createDataFrame([("b", 0, "A", "a#x"), ("b", 1, "B", "b")], "book_id string, pos int, title string, href string")
    text = export.book_json(books, spine, toc).first()["json"]
    assert "<" not in text and "&" not in text and [s["title"] for s in json.loads(text)["spine"]] == ["A & B", "B"]
    heads = spark.createDataFrame([("b", "a", "x", "X"), ("b", "b", None, "F")], "book_id string, file_path string, fragment string, title string")
    assert [r["title"] for r in export.toc_titles(toc, heads).orderBy("pos").collect()] == ["X", "F"]


def test_lists(spark):
    segs = spark.createDataFrame([("b", "s1", "f1", 2), ("b", "s2", "f2", 1)], "book_id string, segment_id string, file_path string, spine_index int")
    state = spark.createDataFrame([("b", "s1", "skipped", "why"), ("b", "gone", "skipped", None)], "book_id string, segment_id string, status string, error_message string")
    skips = spark.createDataFrame([("b", "f3", "index")], "book_id string, file_path string, reason string")
    assert {tuple(r)[1:] for r in export.skip_list(skips, state, segs).collect()} == {("document", "f3", "index"), ("segment", "s1", "why")}
    assert export.lookup(segs, state, "s2").first()["status"] is None and export.same_artifact(segs, state) and not export.same_artifact(segs.where("file_path = 'f2'"), state)
    rows = [r.asDict() for r in export.template_files(segs, skips).collect()]
    text = files.settings_template(rows)
    assert yaml.safe_load(text) == {"translation_files": ["f2", "f1"]} and text.rstrip().endswith('# - "f3"')


def test_files(tmp_path):
    assert files.work_name("/b/Élan vital_2.epub").startswith("elan-") and files.work_name("/b/中.epub").startswith("book-")
    assert yaml.safe_load(files.yaml_scalar('a: "b" \\ #c\n')) == 'a: "b" \\ #c '
    assert files.write_new(str(tmp_path / "x"), "1") and not files.write_new(str(tmp_path / "x"), "2") and (tmp_path / "x").read_text() == "1"
