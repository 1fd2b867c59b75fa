"""Audio books as sound: segments joined into WAV files by prefix sums, with tags and chapter marks, without an external program.

A file is a sequence of pieces: a header that knows all lengths, the frames of each segment, the silence behind it, and the tags. Lengths
come from the segments' own tables, starts from running sums; the frames are never brought together in memory: ``sinks.write_joined``
streams them into place, in the order that Spark has sorted them.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.audio import SEGMENT_SEED_BYTES, pauses

SHAPE = "rate int, width int, channels int"
PARTS = f"book_id string, segment_id string, {SHAPE}, frames binary"
#: What one file of 32-bit sizes can hold; longer ones carry 64-bit sizes beside.
MOST = 0xFFFFFFFF - 4096


def parts(audio: DataFrame) -> DataFrame:
    """(book_id, segment_id, rate, width, channels, frames) of completed ``audio(book_id, segment_id, status, audio)``, each a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                with wave.open(io.BytesIO(batch.column(2)[i].as_py())) as w:
                    row = (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes()))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                made = [pa.array([x], k) for x, k in zip(row, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *made], names=[f.split()[0] for f in PARTS.split(", ")])

    return audio.where("status = 'completed'").select("book_id", "segment_id", "audio").mapInArrow(run, PARTS)


def with_gaps(plan: DataFrame, low: float = 2.0, high: float = 4.0) -> DataFrame:
    """``plan(book_id, segment_id, ...)`` with the silence behind each segment, which depends on its id only, as gap_ms."""

    @F.pandas_udf("long")
    def gap(ids):
        return ids.map(lambda i: pauses(i, 1, low, high, SEGMENT_SEED_BYTES)[0])

    return plan.withColumn("gap_ms", gap("segment_id"))


def laid_out(plan: DataFrame, found: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A row for each piece of sound in each file: ``by`` names a file, ``order`` the order of its segments.

    Columns: *by, chapter_file, segment_id, nth, shape, frames, n_frames, silent (frames of silence behind; none behind the last), start
    (frames before it). The frames of ``found`` stay where they are; only their lengths take part in the running sums.
    """
    bytes_a_frame = F.col("width") * F.col("channels")
    sized = found.select("book_id", "segment_id", "rate", "width", "channels", (F.octet_length("frames") / bytes_a_frame).cast("long").alias("n_frames"))
    rows = plan.join(sized, ["book_id", "segment_id"])
    within = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(within)).withColumn("last", F.lead("nth").over(within).isNull())
    rows = rows.withColumn("silent", F.when(F.col("last"), F.lit(0).cast("long")).otherwise(F.floor(F.col("gap_ms") * F.col("rate") / 1000)))
    before = F.sum(F.col("n_frames") + F.col("silent")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))


def _header(total: int, rate: int, width: int, channels: int, behind: int) -> bytes:
    """The bytes in front of the frames, of a file with so many bytes of sound and so many bytes behind it."""
    shape = struct.pack("<HHIIHH", 1, channels, rate, rate * width * channels, width * channels, 8 * width)
    whole = 4 + 36 + 24 + 8 + total + total % 2 + behind
    if whole <= MOST:
        return b"RIFF" + struct.pack("<I", whole) + b"WAVE" + b"JUNK" + struct.pack("<I", 28) + bytes(28) + b"fmt " + struct.pack("<I", 16) + shape + b"data" + struct.pack("<I", total)
    sizes = struct.pack("<QQQI", whole, total, total // (width * channels), 0)
    return b"RF64" + b"\xff" * 4 + b"WAVE" + b"ds64" + struct.pack("<I", 28) + sizes + b"fmt " + struct.pack("<I", 16) + shape + b"data" + b"\xff" * 4


def _chunk(name: bytes, content: bytes) -> bytes:
    return name + struct.pack("<I", len(content)) + content + b"\0" * (len(content) % 2)


#: Names of tags in a RIFF file.
INFO = {"title": b"INAM", "artist": b"IART", "album": b"IPRD", "date": b"ICRD", "genre": b"IGNR", "composer": b"IMUS"}


def trailer(tags: dict[str, str], marks: list[tuple[int, str]]) -> bytes:
    """The bytes behind the frames: tags, and chapter marks as (frame, title)."""
    listed = b"".join(_chunk(INFO[k], v.encode() + b"\0") for k, v in tags.items() if k in INFO and v)
    out = _chunk(b"LIST", b"INFO" + listed) if listed else b""
    if marks:
        points = b"".join(struct.pack("<II4sIII", i, at & 0xFFFFFFFF, b"data", 0, 0, at & 0xFFFFFFFF) for i, (at, _) in enumerate(marks, 1))
        labels = b"".join(_chunk(b"labl", struct.pack("<I", i) + title.encode() + b"\0") for i, (_, title) in enumerate(marks, 1))
        out += _chunk(b"cue ", struct.pack("<I", len(marks)) + points) + _chunk(b"LIST", b"adtl" + labels)
    return out


def read_marks(data: bytes) -> tuple[dict[str, str], list[tuple[int, str]]]:
    """(tags, chapter marks) of a WAV file."""
    tags, at_frame, names, pos = {}, {}, {}, 12
    known = {v: k for k, v in INFO.items()}

    def inner(begin: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        while begin + 8 <= end:
            size = struct.unpack_from("<I", data, begin + 4)[0]
            yield data[begin : begin + 4], data[begin + 8 : begin + 8 + size]
            begin += 8 + size + size % 2

    while pos + 8 <= len(data):
        name, size = data[pos : pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        body = pos + 8
        if name == b"LIST":
            for n, c in inner(body + 4, body + size):
                if n in known:
                    tags[known[n]] = c.rstrip(b"\0").decode()
                elif n == b"labl":
                    names[struct.unpack_from("<I", c)[0]] = c[4:].rstrip(b"\0").decode()
        elif name == b"cue ":
            for i in range(struct.unpack_from("<I", data, body)[0]):
                ident, frame = struct.unpack_from("<II", data, body + 4 + 24 * i)
                at_frame[ident] = frame
        pos = body + size + size % 2
    return tags, [(f, names.get(i, "")) for i, f in sorted(at_frame.items())]


def pieces(rows: DataFrame, found: DataFrame, by: list[str], path: Column, tags: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(path, nth, content) of files in the layout of ``laid_out``, for ``sinks.write_joined``.

    ``tags(book_id, tags)``; ``titles(book_id, chapter_file, title)`` name the marks at the first segment of each chapter. A file whose
    segments differ in their shape fails. A row holds one segment's frames, or the marks of one file, a number and a title a chapter.
    """
    shape = F.struct("rate", "width", "channels")
    ends = rows.groupBy(*by).agg(
        F.min(shape).alias("shape"), F.max(shape).alias("other"), F.sum(F.col("n_frames") + F.col("silent")).alias("frames"),
    )
    first = rows.groupBy(*by, *(["chapter_file"] if "chapter_file" not in by else [])).agg(F.min("start").alias("at"))
    named = first.join(titles, ["book_id", "chapter_file"], "left") if titles is not None else first.withColumn("title", F.col("chapter_file"))
    marks = named.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("title", F.col("chapter_file")).alias("title")))).alias("marks"))
    ends = ends.join(marks, by)
    ends = ends.join(tags, "book_id", "left") if tags is not None else ends.withColumn("tags", F.create_map().cast("map<string,string>"))
    differ = F.raise_error(F.concat(F.lit("the speaker changed its format in "), F.col("book_id"))).cast("struct<rate:int,width:int,channels:int>")
    ends = ends.withColumn("shape", F.when(F.col("shape") == F.col("other"), F.col("shape")).otherwise(differ))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, form, frames, points, own in zip(*(c.to_pylist() for c in batch.columns)):
                behind = trailer(dict(own or {}), [(p["at"], p["title"]) for p in points])
                total = frames * form["width"] * form["channels"]
                out += [(name, -1, _header(total, form["rate"], form["width"], form["channels"], len(behind))), (name, 1 << 40, b"\0" * (total % 2) + behind)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [(), (), ()], (pa.string(), pa.int64(), pa.binary()))], names=["path", "nth", "content"]
            )

    around = ends.select(path.alias("path"), "shape", "frames", "marks", "tags").mapInArrow(edges, "path string, nth bigint, content binary")
    silence = F.unhex(F.repeat(F.lit("00"), (F.col("silent") * F.col("width") * F.col("channels")).cast("int")))
    spoken = rows.join(found.select("book_id", "segment_id", "frames"), ["book_id", "segment_id"])
    sound = spoken.select(path.alias("path"), F.col("nth").cast("long").alias("nth"), F.concat("frames", silence).alias("content"))
    return around.union(sound)
