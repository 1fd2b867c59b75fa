import pytest
from pyspark.sql import functions as F

from quire.functions import paths, text


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + ", ".join(f"c{k} string" for k in range(len(inputs[0]) if isinstance(inputs[0], tuple) else 1)))
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.orderBy("i").select(expression(*cols)).collect()]


CASES = [
    (text.dots, {"Wait . . . what": "Wait ... what", "a . . . . b": "a ... b", "Multiple ...dots  here.": "Multiple ... dots  here.", "end...": "end..."}),
    (text.spoken_dots, {"a . . . b": "a ... b", "one. two": "one. two"}),
    (text.collapse, {" a \t b\n": "a b", "\u00a0x\u2003y": "x y"}),
    (lambda c: text.copy_class(c) != "translate", {"…": True, "123-125": True, "p. 42": True, "Fig.": False, "Hello world": False, "ISBN 978-0-123-45678-9": True, "ISBN numbers are assigned": False, "": True}),
    (
        text.refused,
        {
            "I'm sorry, I can't help with that.": True, "I'm sorry for your loss, my friend.": False, "抱歉，我来晚了。": False, "抱歉，我不能完成这个请求。": True,
            "As an AI, no": True, "": False, "I’m unable to": True,
        },
    ),
    (text.chinese_target, {"zh": True, "zh-CN": True, "zh_Hans": True, "中文": True, "English": False, "en": False, "ja": False, "Simplified Chinese": True}),
    (text.polish_cjk, {"第3章": "第 3 章", "中文--英文": "中文 —— 英文", "温度25℃很热": "温度 25℃ 很热", "文字 . . . 更多文字": "文字... 更多文字", "plain3 text": "plain3 text"}),
    (text.slug, {"Chapter 1: Introduction": "chapter-1-introduction", "A" * 100: "a" * 50, "!!!": "untitled"}),
    (text.ascii_slug, {"My  Book é!": "My_Book_", "!": "audiobook"}),
    (text.narrator, {"en-US-GuyNeural": "Guy", "alloy": "alloy", "en-US-JennyMultilingualNeural": "Jenny"}),
    (text.seconds, {"1:23:45": 5025.0, "23:45": 1425.0, "45.5": 45.5, "1:9:2": 4142.0}),
    (text.note_identifier, {"ftn3": True, "footnote-2": True, "fn1": True, "fnord": False, "banknote": False}),
    (text.no_words, {"***": True, "a*": False, "é": False}),
    (text.language_code, {"zh_TW": "zh-TW", " German ": "de", "": "auto", "Klingon": "Klingon"}),
    (text.deepl_code, {"zh-CN": "ZH-HANS", "de": "DE", "Polish": "PL", "x": None}),
    (text.dangerous_url, {"java\tscript:alert(1)": True, "JAVASCRIPT:x": True, "data:text/html,x": True, "data:image/png,x": False, "a.html": False}),
    (text.external_url, {"HTTPS://x": True, "mailto:a": True, "a/b": False, "#x": True}),
    (text.stem, {"Text/ch1.xhtml": "ch1", "a.b.c": "a.b", "noext": "noext", ".hidden": ".hidden"}),
    (text.title_from_path, {"Text/my_first_chapter.xhtml": "My First Chapter", "doc_12.x": "Doc 12", "it's.x": "It'S"}),
    (text.truncated, {"x" * 81: "x" * 79 + "…", "x" * 80: "x" * 80}),
    (lambda c: text.keyword_match(c, ("cover", "index", "notes", "封面")), {"Discover": None, "The  Index": "index", "Footnotes": None, "Notes and cover": "cover", "书籍封面页": "封面"}),
    (lambda c: text.stamp(c.cast("double")), {"5025": "1:23:45", "45.5": "0:00:45.500", "0": "0:00:00"}),
    (lambda c: F.size(text.sentences(c)), {"First one. Second one! Third one?": 3, "one": 1}),
    (lambda c: F.size(text.sentences(c, cjk=True)), {"这是第一句话。这是第二句话！这是第三句吗？": 3}),
    (text.script_safe, {"</script>&": "\\u003c/script\\u003e\\u0026"}),
    (paths.unsafe_member, {"/etc/x": True, "C:\\x": True, "a/../b": True, "OEBPS/x..y": False}),
    (paths.fragment_of, {"a#b": "b", "a": None, "a#": ""}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_functions(spark, case):
    expression, table = CASES[case]
    assert values(spark, expression, list(table)) == list(table.values())


def test_paths(spark):
    pairs = {
        ("Text/ch1.xhtml", "../images/fig1.png"): "images/fig1.png", ("text/c.xhtml", "image.jpg"): "text/image.jpg", ("c.xhtml", "a/./b"): "a/b",
        ("t/c", "data:image/png;base64,x"): None, ("t/c", "http://e.com/i.jpg"): None, ("t/c", "../../x"): None, ("t/c", "/abs/x"): "abs/x", ("t/c", ""): None,
    }
    assert values(spark, paths.resolved, list(pairs)) == list(pairs.values())


def test_roman_numerals(spark):
    rows = [("I.", "h1", 3, "One."), ("V:", "h1", 2, "Five:"), ("Chapter I", "h2", 2, "Chapter One"), ("i", "h2", 2, "One"), ("IV", "p", 1, "Four"), ("I", "p", 4, "I"), ("I am here", "h1", 1, "I am here"), ("MM", "h1", 1, "MM")]
    df = spark.createDataFrame(rows, "t string, e string, n int, w string")
    got = df.select(text.spoken_roman(F.col("t"), F.col("e"), F.col("n")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)
    assert len(text.roman_table()) == 55 and dict((n, w) for n, _, w in text.roman_table())["XLIX"] == "Forty-nine"


def test_prompt(spark):
    df = spark.createDataFrame([("Hi", "text"), ("<b>x</b>", "html")], "c string, m string")
    got = [r[0] for r in df.select(text.prompt(F.col("c"), F.col("m"), F.lit("en"), F.lit("fr"), "{language_instruction} {mode_instruction}")).collect()]
    assert got[0].startswith("Translate from English into French. Return a faithful") and got[0].endswith("SOURCE:\nHi")
    assert "Preserve HTML" in got[1]


def test_slugs_work_through_a_text_once(spark):
    rows = spark.createDataFrame([("??",), ("-" * 60 + "a" * 49 + "- b",), ("-- --",), ("Ünï  cödé_-1!\x85²",), (None,)], "t string")
    made = rows.select(text.slug(F.col("t")).alias("slug"), text.ascii_slug(F.col("t")).alias("ascii_slug"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)") == 2
    got = [tuple(r) for r in made.collect()]
    assert got == [("untitled", "audiobook"), ("a" * 49, "-" * 60 + "a" * 49 + "-_b"), ("untitled", "--_--"), ("ünï-cödé_-1-²", "n_cd_-1_"), (None, None)]
