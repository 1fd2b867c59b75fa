import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from quire.operators import audio, chapters, models, reports, skip, state
from quire.sources import library


@pytest.fixture(scope="module")
def book(spark):
    spine = [("b", f"Text/{n}.xhtml", i) for i, n in enumerate(["cover", "opening", "preface", "chapter1", "chapter1b", "index1", "index2"])]
    toc = [("b", 0, "Cover", "Text/cover.xhtml"), ("b", 1, "Preface", "Text/preface.xhtml#x"), ("b", 2, "Chapter 1", "Text/chapter1.xhtml"), ("b", 3, "Index", "Text/index1.xhtml")]
    return spark.createDataFrame(spine, "book_id string, file_path string, spine_index int"), spark.createDataFrame(toc, "book_id string, pos int, title string, href string")


def test_skips(book):
    spine, toc = book
    got = {r["file_path"]: (r["reason"], r["source"]) for r in skip.candidates(toc, spine).collect()}
    assert got == {"Text/cover.xhtml": ("cover", "toc"), "Text/index1.xhtml": ("index", "toc"), "Text/index2.xhtml": ("after index", "cascade")}
    assert [r["norm"] for r in skip.unmatched_titles(toc, spine).collect()] == ["preface"]


def test_cascade_needs_the_last_part(spark, book):
    spine, _ = book
    toc = spark.createDataFrame([("b", i, t, f"Text/{f}.xhtml") for i, (t, f) in enumerate([("Notes", "opening"), ("A", "preface"), ("B", "chapter1"), ("C", "chapter1b")])], "book_id string, pos int, title string, href string")
    assert {r["source"] for r in skip.candidates(toc, spine).collect()} == {"toc"}


def test_chapters(spark, book):
    spine, toc = book
    blocks = chapters.markdown_blocks(spine, toc, spine).orderBy("start").collect()
    assert [(r["start"], r["title"], len(r["files"])) for r in blocks] == [(0, "Cover", 2), (2, "Preface", 1), (3, "Chapter 1", 2), (5, "Index", 2)]
    late = toc.where("pos >= 1")
    assert [r["title"] for r in chapters.markdown_blocks(spine, late, spine).orderBy("start").collect()][:2] == ["Cover", "Opening"]
    heard = chapters.audio_chapter_of(spine, late).orderBy("spine_index").collect()
    assert [(r["spine_index"], r["title"]) for r in heard] == [(2, "Preface"), (3, "Chapter 1"), (4, "Chapter 1"), (5, "Index")]
    alone = chapters.audio_chapter_of(spine, toc.where("pos > 9")).collect()
    assert len(alone) == 7 and all(r["chapter_file"] == r["file_path"] for r in alone)
    named = spark.createDataFrame([(None, "", "Doc", "t/my_file.x"), ("C", "T", None, "f"), (None, None, " ", "t/my_file.x")], "c string, t string, d string, p string")
    assert [r[0] for r in named.select(chapters.chapter_title(*map(F.col, "ctdp"))).collect()] == ["Doc", "C", "My File"]


def test_chapter_problems_and_starts(spark):
    rows = [("b", 0, "A", 0.0, 100.0), ("b", 1, " ", None, 100.0), ("b", 2, "C", -1.0, 100.0), ("b", 3, "D", -1.0, 100.0), ("b", 4, "E", 101.0, 100.0)]
    df = spark.createDataFrame(rows, "book_id string, position int, title string, start double, duration double")
    got = {(r["position"], r["problem"]) for r in chapters.problems(df).collect()}
    assert got == {(1, "empty title"), (1, "missing start"), (2, "negative start"), (3, "negative start"), (3, "not after the previous chapter"), (4, "beyond the end")}
    lengths = spark.createDataFrame([("b", 0, 1500), ("b", 1, 700), ("b", 2, 1)], "book_id string, position int, duration_ms long")
    assert [r["start_ms"] for r in chapters.starts_ms(lengths, 10).orderBy("position").collect()] == [10, 1510, 2210]


def test_state(spark):
    segs = spark.createDataFrame([("b", f"s{i}") for i in range(6)], "book_id string, segment_id string")
    rows = [("b", "s0", "completed", "x", "p", None), ("b", "s1", "completed", "y", None, None), ("b", "s2", "error", None, "p", "e"), ("b", "s3", "skipped", None, None, None), ("b", "gone", "completed", "I cannot do that", "p", None)]
    st = spark.createDataFrame(rows, "book_id string, segment_id string, status string, translation string, provider_name string, error_message string")
    ids = lambda df: sorted(r["segment_id"] for r in df.collect())
    assert ids(state.pending(segs, st)) == ["s2", "s3", "s4", "s5"] and ids(state.orphans(segs, st)) == ["gone"] and ids(state.injectable(segs, st)) == ["s0"]
    assert state.ensured(segs, st).count() == 7 and {r["status"] for r in state.ensured(segs, st, False).collect()} == {"pending"}
    assert {r["status"] for r in state.reset_errors(st).where("segment_id = 's2'").collect()} == {"pending"}
    assert state.reset_errors(st, []).where("status = 'error'").count() == 1 and state.reset_errors(st, [], True).where("status = 'error'").count() == 0
    assert ids(state.purged(st).where("status = 'pending'")) == ["gone"]
    r = state.resume_counts(segs, st).first()
    assert (r["remaining"], r["completed"], r["skipped"], r["first_completed"]) == (3, 2, 1, "s0")
    assert ids(state.resume(segs, st).where("kind = 'remaining'")) == ["s2", "s4", "s5"]
    new = st.where("segment_id = 's2'").withColumn("status", F.lit("completed")).unionByName(st.where("segment_id = 's0'").withColumn("segment_id", F.lit("new")))
    assert state.merged(st, new).count() == 6 and state.merged(st, new, insert=False).count() == 5
    audio_rows = st.selectExpr("*", "'f.m4a' as audio_path", "1.5D as duration_seconds")
    assert state.invalidated(audio_rows, {"voice": "a"}, {"voice": "b"}).where("status = 'pending' and audio_path is null").count() == 3
    assert state.invalidated(audio_rows, {"voice": "a", "cover": 1}, {"voice": "a", "cover": 2}).where("status = 'completed'").count() == 3


def test_failure_runs(spark):
    events = spark.createDataFrame([("k", i, f) for i, f in enumerate([True, True, False, True, True, True, False])], "k string, t int, bad boolean")
    got = state.failure_runs(events, "k", ["t"], F.col("bad")).orderBy("t").collect()
    assert [r["run"] for r in got] == [1, 2, 0, 1, 2, 3, 0]


def test_language_votes(spark):
    rows = [("b", 0, "fr"), ("b", 1, "en"), ("b", 2, "en"), ("b", 3, "fr"), ("c", 5, "de")]
    got = dict(r[:2] for r in reports.language_votes(spark.createDataFrame(rows, "book_id string, pos int, language string")).collect())
    assert got == {"b": "fr", "c": "de"}


def test_models(spark):
    class Bad(models.Stub):
        html = False

        def translate(self, content, source, target):
            if "boom" in content:
                raise RuntimeError("down")
            return "" if "blank" in content else super().translate(content, source, target)

    rows = [("b", "1", "text", "Hello"), ("b", "2", "text", "123"), ("b", "3", "html", "<b>x</b> y z"), ("b", "4", "text", "blank it"), ("b", "5", "text", "boom it")]
    df = spark.createDataFrame(rows, "book_id string, segment_id string, extract_mode string, source_content string")
    got = {r["segment_id"]: r for r in models.translate(df, Bad, "en", "French", attempts=1).collect()}
    assert got["1"]["translation"] == "[French] HELLO" and got["2"]["provider_name"] is None and got["2"]["translation"] == "123"
    assert [got[i]["status"] for i in "345"] == ["error"] * 3 and got["5"]["error_message"] == "down"
    tries = []
    with pytest.raises(OSError):
        models.attempted(lambda: (tries.append(1), (_ for _ in ()).throw(OSError()))[1], sleep=lambda s: tries.append(s))
    assert tries == [1, 1.0, 1, 2.0, 1] and models.retryable(503) and not models.retryable(404)
    assert models.answer_text({"output": [{"content": None}, {"content": [{"text": "a"}, {"text": "b"}]}]}) == "ab"


def test_audio(spark):
    atom = audio.chapter_atom([(1.5, "One"), (60, "é" * 200)])
    assert atom[:8] == b"\x01" + bytes(7) and atom[8] == 2 and audio.read_chapter_atom(atom)[0] == (1.5, "One")
    assert audio.read_chapter_atom(atom)[1][1] == "é" * 127
    with pytest.raises(ValueError):
        audio.chapter_atom([(0, "x")] * 256)
    assert audio.pauses("a", 3, 1, 2) == audio.pauses("a", 3, 1, 2) != audio.pauses("b", 3, 1, 2) and all(1000 <= x < 2000 for x in audio.pauses("a", 9, 1, 2))
    assert 2000 <= audio.chapter_gap(1) < 4000 and audio.read_chapter_atom(audio.chapter_atom([(0.0005, " ")])) == [(0.0005, "Chapter")]
    made = audio.with_pauses(spark.createDataFrame([("a", 4), ("b", 0)], "segment_id string, n_sentences int"), 1, 2).collect()
    assert {r["segment_id"]: r["pause_ms"] for r in made} == {"a": sum(audio.pauses("a", 3, 1, 2)), "b": 0}
    rows = spark.createDataFrame([("en-US", "b"), ("en-GB", "a"), ("de-DE", "c")], "locale string, short_name string")
    assert [r[1] for r in audio.voices(rows, "EN").collect()] == ["a", "b"] and audio.voices(rows, "xx").count() == 0


class _Answers(BaseHTTPRequestHandler):
    """A service that is busy once, then answers in the shape of its path."""

    busy = 1

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/wrong":
            self.send_error(404)
            return
        if _Answers.busy:
            _Answers.busy -= 1
            self.send_error(503)
            return
        said = json.dumps(body)[-60:]
        answer = {
            "/responses": {"output": [{"content": [{"text": said}]}]},
            "/chat": {"choices": [{"message": {"content": said}}]},
            "/messages": {"content": [{"text": said}]},
            "/contents": {"candidates": [{"content": {"parts": [{"text": said}]}}]},
            "/generate": {"response": said},
        }[self.path]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


def test_services():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = models.Request("Hello", "text", "en", "French", "Translate.\n\nSOURCE:\nHello")
    for shape in models.SHAPES:
        client = models.Service(f"{base}/{shape}", "m", shape, headers={"Authorization": "Bearer k"})
        assert "Hello" in models.attempted(lambda: client.respond(asked), sleep=lambda s: None)
    with pytest.raises(models.FatalError):
        models.attempted(lambda: models.Service(f"{base}/wrong", "m").respond(asked))
    server.shutdown()


def test_speech(spark):
    class Bad(models.SilentSpeaker):
        def synthesize(self, text, voice):
            if "boom" in text:
                raise OSError("down")
            return super().synthesize(text, voice)

    plan = spark.createDataFrame([("b", "1", "One sentence. Two here."), ("b", "2", None), ("b", "3", "boom")], "book_id string, segment_id string, spoken string")
    got = {r["segment_id"]: r for r in models.render(plan, Bad, "v", attempts=2, wait_s=0).collect()}
    assert set(got) == {"1", "3"} and got["3"]["status"] == "error" and got["3"]["audio"] is None
    pause = audio.pauses("1", 1, 0.2, 0.6)[0] / 1000
    assert abs(got["1"]["duration_seconds"] - (0.13 + 0.09 + pause)) < 0.002


def test_audio_lists_and_tags(spark):
    plan = spark.createDataFrame([("b", "c", 2, "it's.m4a"), ("b", "c", 1, "a.m4a")], "book_id string, chapter_file string, position int, audio_path string")
    assert audio.concat_lists(plan).first()["lines"] == "file 'a.m4a'\nfile 'it'\\''s.m4a'"
    meta = spark.createDataFrame([("b", "T", None, "1999")], "book_id string, title string, creator string, year string")
    assert audio.tags(meta, "Aria").first()["tags"] == {"title": "T", "composer": "Aria", "date": "1999", "genre": "Audiobook"}


def box(name, content):
    return (len(content) + 8).to_bytes(4, "big") + name + content


def test_chapters_in_a_container():
    sound = box(b"mdat", b"SOUND")
    clock = box(b"mvhd", bytes(12) + (600).to_bytes(4, "big") + (1200).to_bytes(4, "big"))

    def movie(offset):
        return box(b"moov", clock + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stco", bytes(4) + (1).to_bytes(4, "big") + offset.to_bytes(4, "big")))))))

    start = box(b"ftyp", b"M4A ")
    first = start + movie(len(start) + len(movie(0)) + 8) + sound
    chapters = [(0.0, "One"), (1.5, "Zwei \u00e9")]
    for whole in (first, start + sound + movie(len(start) + 8)):
        for listed in (chapters, [(0.0, "A")], chapters):
            whole = audio.with_chapters(whole, listed)
            assert audio.read_mp4(whole) == (listed, 2.0)
            table = audio._inside(whole, b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stco")
            at = int.from_bytes(whole[table[2] + 8 : table[2] + 12], "big")
            assert whole[at : at + 5] == b"SOUND"
    for bad in (first, b"\0\0\0\3abcd"):
        with pytest.raises(ValueError):
            audio.read_mp4(bad)


def test_plans_work_through_a_text_once(spark):
    rows = [("b", "f-1", "One . . . two", 1), ("b", "f-2", "—", 2), ("b", "f-3", "Three", 3), ("b", "f-4", "four", 4)]
    rows = spark.createDataFrame(rows, "book_id string, segment_id string, source_content string, order_in_file long")
    rows = rows.withColumns({"element_type": F.lit("p"), "xpath": F.lit("/p"), "skip_reason": F.when(F.col("order_in_file") == 4, "Index")})
    records = spark.createDataFrame([("b", "f-3", "skipped"), ("b", "f-1", "error")], "book_id string, segment_id string, status string")
    plan = state.audio_plan(rows, records)
    got = {r["segment_id"]: (r["spoken"], r["skipped_because"]) for r in plan.collect()}
    want = {"f-1": ("One ... two", None), "f-2": (None, "nothing to speak"), "f-3": ("Three", "translation skipped"), "f-4": ("four", "file skipped: Index")}
    assert got == want and "__silent" not in plan.columns and "__heard" not in plan.columns
    todo = plan.where("skipped_because is null").select("segment_id")._jdf.queryExecution().optimizedPlan().toString()
    assert todo.count("regexp_replace(source_content") == 1 and "source_content" not in todo.split("Filter CASE")[1].split("\n")[0]


def test_blank_lines_are_told_without_their_text(spark, tmp_path):
    odd = ["", " ", "\u3000\x85\x1c\t", "\u200b", " . . . ", "a\r", "\xa0", "x  y"]
    docs = [(1, "\n".join(odd), "en", "s0", 1), (2, " \n\t", "en", "s0", 1), (3, None, "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = library.segments(spark, str(tmp_path))
    got = [(r["doc_id"], r["order_in_file"], r["xpath"], r["source_content"]) for r in rows.orderBy("doc_id", "order_in_file").collect()]
    assert got == [(1, 1, "/html/body/p[4]", "\u200b"), (1, 2, "/html/body/p[5]", "..."), (1, 3, "/html/body/p[6]", "a"), (1, 4, "/html/body/p[8]", "x y")]
    assert "regexp_replace(raw" not in rows.select("doc_id", "order_in_file")._jdf.queryExecution().optimizedPlan().toString()
