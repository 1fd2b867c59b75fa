"""Sound joined into WAV files: frames, silence, tags and marks, read back with the standard library."""

import io
import struct
import wave

import pytest
from pyspark.sql import functions as F

from quire.operators import models, sound
from quire.sources import sinks

RATE = 8000


def tables(spark, rates=(RATE,) * 6):
    """(plan, audio): two chapters of book a, one of book b; every segment has frames of its own."""
    frames = [bytes([i + 1, 0]) * (400 * (i + 1)) for i in range(6)]
    where = [("a", "c1", 0, 1), ("a", "c1", 0, 2), ("a", "c2", 1, 1), ("b", "c1", 0, 1), ("b", "c1", 0, 2), ("a", "c2", 1, 2)]
    plan = spark.createDataFrame([(b, c, f"s{i}", at, nth) for i, (b, c, at, nth) in enumerate(where)], "book_id string, chapter_file string, segment_id string, spine_index int, order_in_file int")
    rows = [(b, f"s{i}", "completed", models.wav(frames[i], rates[i])) for i, (b, *_) in enumerate(where)] + [("a", "s9", "error", None)]
    return plan, spark.createDataFrame(rows, "book_id string, segment_id string, status string, audio binary").repartition(3), frames


def joined(spark, tmp_path, by, path, rates=(RATE,) * 6):
    plan, audio, frames = tables(spark, rates)
    found = sound.parts(audio)
    rows = sound.laid_out(sound.with_gaps(plan, 0.01, 0.05), found, by, ["spine_index", "order_in_file"])
    tags = spark.createDataFrame([("a", {"title": "Ä book", "artist": "X", "odd": "y"})], "book_id string, tags map<string,string>")
    titles = spark.createDataFrame([("a", "c1", "One"), ("a", "c2", "Zwei é")], "book_id string, chapter_file string, title string")
    sinks.write_joined(sound.pieces(rows, found, by, path, tags, titles), str(tmp_path))
    return rows.collect(), frames


def test_chapters_are_their_segments_and_pauses(spark, tmp_path):
    rows, frames = joined(spark, tmp_path, ["book_id", "chapter_file"], F.concat("book_id", F.lit("/"), "chapter_file", F.lit(".wav")))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.wav")) == ["a/c1.wav", "a/c2.wav", "b/c1.wav"]
    for name, ids in (("a/c1", (0, 1)), ("a/c2", (2, 5)), ("b/c1", (3, 4))):
        silent = {r["segment_id"]: r["silent"] for r in rows}
        want = b"".join(frames[i] + bytes(2 * silent[f"s{i}"]) for i in ids)
        with wave.open(str(tmp_path / f"{name}.wav")) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnchannels()) == (RATE, 2, 1) and w.readframes(w.getnframes()) == want
        assert 80 <= silent[f"s{ids[0]}"] <= 400 and silent[f"s{ids[1]}"] == 0


def test_books_carry_tags_and_marks(spark, tmp_path):
    rows, _ = joined(spark, tmp_path, ["book_id"], F.concat("book_id", F.lit(".wav")))
    data = (tmp_path / "a.wav").read_bytes()
    tags, marks = sound.read_marks(data)
    start = {r["segment_id"]: r["start"] for r in rows}
    assert tags == {"title": "Ä book", "artist": "X"} and marks == [(0, "One"), (start["s2"], "Zwei é")]
    assert struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    assert sound.read_marks((tmp_path / "b.wav").read_bytes()) == ({}, [(0, "c1")])


def test_a_changed_format_fails(spark, tmp_path):
    with pytest.raises(Exception, match="changed its format"):
        joined(spark, tmp_path, ["book_id"], F.concat("book_id", F.lit(".wav")), (RATE, RATE, 16000, RATE, RATE, RATE))
    assert not list(tmp_path.rglob("*.wav"))


def test_long_files_have_wide_sizes():
    head = sound._header(5 << 30, 48000, 2, 2, 100)
    assert head[:4] == b"RF64" and head[12:16] == b"ds64" and struct.unpack_from("<QQ", head, 20) == (4 + 36 + 24 + 8 + (5 << 30) + 100, 5 << 30)
    assert len(head) == len(sound._header(1000, 48000, 2, 2, 0))
    with wave.open(io.BytesIO(sound._header(4, 8000, 2, 1, 0) + b"abcd")) as w:
        assert w.readframes(2) == b"abcd"
