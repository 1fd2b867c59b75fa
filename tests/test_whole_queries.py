import re

import pytest

from quire.plans.queries import QUERIES

LINES = ["One  line", "", "two", "three " * 40, "four", "five . . . end"]
TEXTS = ["\n".join(LINES), "A title: " + "word " * 40, "?" * 100 + "Kept", " " * 95 + "Late title", "x/" * 60 + " end"]
HEADS = ["Plain", "Salt &amp; Pepper", "Caf&#233;  x", "A &lt; B"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "en", "s0", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    pages = [(i, f"http://a.org/{i}", f"<html><body><h1>{h}</h1><p>t</p></body></html>") for i, h in enumerate(HEADS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def test_prompts_of_every_segment(spark, folder):
    got = QUERIES["segment_prompts"](spark, folder).collect()
    lines = [re.sub(r"\. \. \.", "...", " ".join(x.split())) for t in TEXTS for x in t.split("\n") if x.strip()]
    assert sorted(r["preview"] for r in got) == sorted(x if len(x) <= 80 else x[:79] + "…" for x in lines) and len(got) == 9
    assert sorted(r["prompt"].split("SOURCE:\n", 1)[1] for r in got) == sorted(lines)


def test_titles_with_character_references(spark, folder):
    got = {r["page_id"]: r["raw_title"] for r in QUERIES["heading_titles"](spark, folder).collect()}
    assert got == {0: "Plain", 1: "Salt & Pepper", 2: "Café x", 3: "A < B"}


def test_slugs_of_whole_texts(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["text_slugs"](spark, folder).collect()}
    for i, t in enumerate(x.replace("\n", " ") for x in TEXTS):
        name = re.sub(r"\s+", "-", re.sub(r'[<>:"/\\|?*!]', "", t).strip()).lower().strip("-")
        plain = re.sub(r"[^A-Za-z0-9_-]", "", re.sub(r"\s+", "_", t.strip()))
        assert (got[i]["slug"], got[i]["ascii_slug"]) == (name[:50].rstrip("-") or "untitled", plain or "audiobook")
    assert got[2]["slug"] == "kept" and got[3]["slug"] == "late-title" and len(got[1]["ascii_slug"]) > 90
