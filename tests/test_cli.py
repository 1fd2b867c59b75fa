import io
import json
import os
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
import yaml
from pyspark.sql import functions as F

from quire import cli
from quire.operators import models, sound
from quire.sources import epub, files
from tests.operators.test_tables import box
from tests.sources.test_books import PARTS

CSS = ("OEBPS/style.css", b"p { margin: 0 }")


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    parts = [(n, c.replace(b'linear="no"', b"").replace(b"<h1>T</h1>", b'<h1 id="a">Heading</h1>')) for n, c in PARTS]
    (at / "a.epub").write_bytes(epub.written([*parts, CSS], {}))
    work = str(at / "work")
    cli.extract(spark, f"file://{at}", work)
    assert cli.report(spark, work, "progress").first()["n_segments"] == 2
    cli.translate(spark, work, "French")
    return work


def files_below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}


def test_state_and_reports(spark, work):
    done = cli.report(spark, work, "dashboard").first()
    assert done["n_completed"] == 2 and done["n_pending"] == 0
    names = ("files", "pending", "resume", "totals", "workspace", "covers")
    assert {cli.report(spark, work, n).count() for n in names} == {1} and cli.report(spark, work, "orphans").count() == 0
    assert [r["completed"] for r in cli.resume(spark, work).collect()] == [2]
    assert all(cli.report(spark, work, n).count() == 0 for n in ("skips", "skip-list", "skip-candidates"))
    ident = spark.read.parquet(f"{work}/segments").first()["segment_id"]
    assert cli.inspect_segment(spark, work, ident).first()["status"] == "completed"
    cli.analyze_skips(spark, work, f"{work}/skip-report")
    version = cli.current(spark, work)
    assert cli.purge_refusals(spark, work, dry_run=True) == 0 and cli.current(spark, work) == version
    cli.format_(spark, work)
    assert cli.current(spark, work) == version + 1


def test_books_come_out_readable(spark, work, tmp_path):
    for mode, ending in (("bilingual", "_bilingual.epub"), ("translated_only", "_translated.epub")):
        cli.export(spark, work, "epub", str(tmp_path), mode)
        (path,) = (p for n, p in files_below(tmp_path).items() if n.endswith(ending))
        parts = dict(epub.read_members(open(path, "rb").read()))
        page, css = parts["OEBPS/text.html"].decode(), parts["OEBPS/style.css"]
        assert "[French] HEADING" in page and ('data-lang="original"' in page) == (mode == "bilingual")
        assert (b"display: none" in css) == (mode == "translated_only")
        spine = epub.package_rows(parts)
        titles = [t["title"] for t in spine["toc"]]
        assert titles == (["One", "In"] if mode == "bilingual" else ["[French] HEADING", "[French] HEADING"])
        assert zipfile.ZipFile(path).namelist()[0] == "mimetype"


def test_web_markdown_and_images(spark, work, tmp_path):
    cli.export(spark, work, "web", str(tmp_path / "web"))
    found = files_below(tmp_path / "web")
    index = open(next(p for n, p in found.items() if n.endswith("index.html"))).read()
    data = json.loads(index.split('id="book">')[1].split("</script>")[0])
    assert data["title"] == "Test Book" and [s["href"] for s in data["spine"]] == ["content/OEBPS/text.html"]
    assert [(t["level"], t["title"], t["href"]) for t in data["toc"]] == [(0, "One", "content/OEBPS/text.html#a"), (1, "In", "content/OEBPS/text.html#b")]
    assert "<title>Test Book</title>" in index and "book.toc" in index
    names = {n.split("/", 1)[1] for n in found}
    assert {"content/OEBPS/text.html", "content/OEBPS/style.css", "content/OEBPS/img/cover.png"} < names and not any(n.endswith((".opf", ".ncx")) for n in names)
    cli.export(spark, work, "web-zip", str(tmp_path / "zip"))
    (archive,) = files_below(tmp_path / "zip").values()
    assert "index.html" in zipfile.ZipFile(io.BytesIO(open(archive, "rb").read())).namelist()
    cli.export(spark, work, "markdown", str(tmp_path / "md"))
    ((name, path),) = files_below(tmp_path / "md").items()
    assert name.endswith("/001_one.md") and open(path).read().startswith("# One\n\n[French] HEADING")
    cli.export(spark, work, "combined", str(tmp_path / "one"))
    assert len(files_below(tmp_path / "one")) == 1
    cli.export(spark, work, "images", str(tmp_path / "img"))
    assert {os.path.basename(n) for n in files_below(tmp_path / "img")} == {"cover.png", "cover_2.png"}
    with pytest.raises(ValueError):
        cli.export(spark, work, "scroll", str(tmp_path))


def test_audiobook(spark, work, tmp_path):
    cli.audiobook_generate(spark, work, make=models.SilentSpeaker)
    made = spark.read.parquet(f"{work}/audio").collect()
    assert len(made) == 2 and all(r["status"] == "completed" and bytes(r["audio"][:4]) == b"RIFF" for r in made)
    cli.audiobook_assemble(spark, work, str(tmp_path / "sound"))
    found = files_below(tmp_path / "sound")
    whole = next(open(p, "rb").read() for n, p in found.items() if "/" not in n)
    tags, marks = sound.read_marks(whole)
    assert len(found) == 2 and tags["title"] == "Test Book" and tags["composer"] == "narrator" and marks == [(0, "One")]
    cli.audiobook_export_chapters(spark, work, str(tmp_path / "lists"))
    (path,) = files_below(tmp_path / "lists").values()
    assert yaml.safe_load(open(path))["chapters"][0]["start"] == 0
    book = tmp_path / "a.m4a"
    book.write_bytes(box(b"ftyp", b"M4A ") + box(b"moov", b"") + box(b"mdat", b"x"))
    cli.main(["audiobook-update-chapters", str(book), path])
    cli.main(["audiobook-read-chapters", str(book), str(tmp_path / "read.yaml")])
    assert [c["title"] for c in yaml.safe_load((tmp_path / "read.yaml").read_text())["chapters"]] == ["One"]


def test_settings_change_results(spark, work, tmp_path):
    """A key of a YAML file reaches the command: what is skipped, what is translated into what, which form goes out."""
    books = tmp_path / "books"
    books.mkdir()
    parts = [(n, c.replace(b'linear="no"', b"")) for n, c in PARTS]
    (books / "a.epub").write_bytes(epub.written(parts, {}))
    config = tmp_path / "c.yaml"
    config.write_text("target_language: German\noutput_mode: translated-only\nskip_rules: [one]\ntranslation_workers: 1\n")
    at = str(tmp_path / "w")
    run = lambda *words: cli.main(["-q", "--work", at, "--config", str(config), *words])
    run("extract", f"file://{books}")
    assert spark.read.parquet(f"{at}/skips").first()["reason"] == "one"
    run("translate")
    assert cli.report(spark, at, "dashboard").first()["n_completed"] == 0  # its only file is skipped
    config.write_text("target_language: German\noutput_mode: translated-only\ntranslation_files: [OEBPS/text.html]\n")
    run("translate")
    state = cli.load(spark, at, "state")[0].where("provider_name is not null").collect()
    assert {r["translation"] for r in state} == {"[German] T", "[German] X"}
    run("export", "epub", str(tmp_path / "out"))
    assert [n.rsplit("_", 1)[1] for n in files_below(tmp_path / "out")] == ["translated.epub"]
    config.write_text("translation_workers: 0\n")
    with pytest.raises(SystemExit):
        run("translate")


def test_layers_of_settings(tmp_path):
    (tmp_path / "home/.quire").mkdir(parents=True)
    for name, text in (("home/.quire/config.yaml", "target_language: A\nsource_language: A\noutput_mode: A\nwork_dir: A\naudiobook_voice: A"), (".env", "QUIRE_SOURCE_LANGUAGE='B'\nexport QUIRE_WORK_DIR=B\n# x=1\nQUIRE_OUTPUT_MODE=B\nQUIRE_AUDIOBOOK_VOICE=B"),
                       ("config.yaml", "output_mode: C\nwork_dir: C\naudiobook_voice: C"), ("named.yaml", "audiobook_voice: E")):
        (tmp_path / name).write_text(text)
    layers = files.setting_layers(str(tmp_path / "named.yaml"), str(tmp_path / "home"), str(tmp_path), {"QUIRE_WORK_DIR": "D", "QUIRE_AUDIOBOOK_VOICE": "D", "QUIRE_SKIP_RULES": "x,y"})
    got, unknown = files.settings(layers)
    assert [got[k] for k in ("target_language", "source_language", "output_mode", "work_dir", "audiobook_voice", "skip_rules")] == ["A", "B", "C", "D", "E", ["x", "y"]]
    with pytest.raises(FileNotFoundError):
        files.setting_layers(str(tmp_path / "none.yaml"))


def test_two_writers_lose_nothing(spark, work):
    """Two translations of one state at a time: the answers of both are in the latest version."""
    state = cli.state_log(spark, work)
    before = state.version()
    old = state.table()
    ids = [r["segment_id"] for r in old.select("segment_id").orderBy("segment_id").collect()]
    change = lambda i: lambda now: now.withColumn("error_message", F.when(F.col("segment_id") == ids[i], F.lit(f"by {i}")).otherwise(F.col("error_message")))
    with ThreadPoolExecutor(2) as pool:
        versions = list(pool.map(lambda i: cli.state_log(spark, work).commit(change(i)), (0, 1)))
    assert sorted(versions) == [before + 1, before + 2]
    assert {r["error_message"] for r in cli.load(spark, work, "state")[0].collect()} == {"by 0", "by 1"}


def test_settings_and_work_folders(spark, work, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("odd: 1\naudiobook_workers: 0\noutput_mode: both\nback_matter_threshold: .nan\nskip_rules: x\n")
    assert [w.split(":")[0] for w in cli.config_validate(None, str(path))] == [
        "unknown key", "not a number from 1 on", "not between 0.0 and 1.0", "neither bilingual nor translated_only", "not a list",
    ]
    cli.main(["config-reset", str(path), "--backup"])
    assert cli.config_validate(None, str(path)) == [] and (tmp_path / "c.yaml.bak").read_text().startswith("odd")
    assert cli.config_template(spark, work, str(tmp_path / "t")) == 1 and cli.config_template(spark, work, str(tmp_path / "t")) == 0
    with pytest.raises(ValueError):
        cli.extract(spark, "file:///elsewhere", work)
