"""Audio books as plans: what is spoken in which order, pauses, and MP4 chapter atoms."""

from __future__ import annotations

import hashlib
import random
import struct

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.text import concat_line

MOST_CHAPTERS, MOST_TITLE = 255, 255
VOICES = ("alloy", "echo", "fable", "onyx", "nova", "shimmer")


# Bytes of a digest that seed pauses, and the first seed of gaps between chapters.
SENTENCE_SEED_BYTES, SEGMENT_SEED_BYTES, GAP_SEED = 4, 8, 0xA10D10


def pauses(name: str, count: int, low: float, high: float, seed_bytes: int = SENTENCE_SEED_BYTES) -> list[int]:
    """Pauses in milliseconds that depend on a name only: between sentences, or between segments of a file."""
    rng = random.Random(int.from_bytes(hashlib.sha256(name.encode()).digest()[:seed_bytes], "big"))
    return [int(rng.uniform(low, high) * 1000) for _ in range(count)]


def chapter_gap(index: int, low: float = 2.0, high: float = 4.0) -> int:
    """The silence behind the chapter with this number, from 1, in milliseconds."""
    return int(random.Random(GAP_SEED + index).uniform(low, high) * 1000)


def with_pauses(segments: DataFrame, low: float, high: float) -> DataFrame:
    """``segments(segment_id, n_sentences)`` with the silence between their sentences as pause_ms."""

    @F.pandas_udf("long")
    def total(ids: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([sum(pauses(i, max(0, n - 1), low, high)) for i, n in zip(ids, counts)])

    return segments.withColumn("pause_ms", total("segment_id", "n_sentences"))


def chapter_atom(chapters: list[tuple[float, str]], timescale: int = 1000) -> bytes:
    """The payload of a ``chpl`` atom for (start in seconds, title)."""
    if len(chapters) > MOST_CHAPTERS:
        raise ValueError(f"more than {MOST_CHAPTERS} chapters")
    out = [b"\x01\x00\x00\x00\x00\x00\x00\x00", bytes([len(chapters)])]
    for start, title in chapters:
        raw = ((title or "").strip() or "Chapter").encode()[:MOST_TITLE].decode("utf-8", "ignore").encode()
        out.append(struct.pack(">QB", round(start * timescale * 10000), len(raw)) + raw)
    return b"".join(out)


def read_chapter_atom(payload: bytes, timescale: int = 1000) -> list[tuple[float, str]]:
    out, at = [], 9
    for _ in range(payload[8]):
        start, size = struct.unpack_from(">QB", payload, at)
        out.append((start / 10000 / timescale, payload[at + 9 : at + 9 + size].decode()))
        at += 9 + size
    return out


def voices(rows: DataFrame, locale: str | None) -> DataFrame:
    """Voices of a locale prefix, in order; without a locale all of them."""
    found = rows if locale is None else rows.where(F.lower("locale").startswith(locale.lower()))
    return found.orderBy("locale", "short_name")


def assembly(segments: DataFrame, chapter_of: DataFrame, audio: DataFrame, gap_ms: int = 0) -> DataFrame:
    """The order in which finished segments are joined, and where each begins in its chapter."""
    ready = audio.where("status = 'completed'").select("book_id", "segment_id", "audio_path", F.round(F.col("duration_seconds") * 1000).cast("long").alias("ms"))
    rows = segments.join(ready, ["book_id", "segment_id"]).join(chapter_of.select("book_id", "file_path", "chapter_file"), ["book_id", "file_path"])
    order = Window.partitionBy("book_id", "chapter_file").orderBy("spine_index", "order_in_file")
    before = F.sum(F.col("ms") + gap_ms).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "book_id", "chapter_file", "segment_id", "audio_path", F.row_number().over(order).alias("position"), F.coalesce(before, F.lit(0)).alias("start_ms"), "ms"
    )


def concat_lists(plan: DataFrame) -> DataFrame:
    """(book_id, chapter_file, lines): what joins each chapter's files in order; a chapter bounds a row."""
    parts = F.sort_array(F.collect_list(F.struct("position", concat_line(F.col("audio_path")).alias("line"))))
    return plan.groupBy("book_id", "chapter_file").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("lines"))


def tags(metadata: DataFrame, narrator: str, album: str = "Audiobook") -> DataFrame:
    """(book_id, tags): what a finished audio book carries besides its sound."""
    named = {"title": F.col("title"), "artist": F.col("creator"), "composer": F.lit(narrator), "date": F.col("year"), "genre": F.lit(album)}
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items()))
    return metadata.select("book_id", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("tags"))


# MP4 containers

_HOLDERS = (b"moov", b"udta", b"trak", b"mdia", b"minf", b"stbl")


def atoms(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[bytes, int, int, int]]:
    """(name, begin, begin of its content, end) of the atoms of a stretch."""
    out, at, end = [], start, len(data) if end is None else end
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("not an MP4 container")
        out.append((name, at, at + head, at + size))
        at += size
    return out


def _inside(data: bytes, *path: bytes) -> tuple[bytes, int, int, int] | None:
    start, end, found = 0, len(data), None
    for name in path:
        found = next((a for a in atoms(data, start, end) if a[0] == name), None)
        if found is None:
            return None
        start, end = found[2:]
    return found


def _clock(data: bytes) -> tuple[int, float]:
    """(units a second, seconds) of a movie."""
    head = _inside(data, b"moov", b"mvhd")
    if head is None:
        return 1000, 0.0
    at = head[2]
    wide = data[at] == 1
    scale = int.from_bytes(data[at + (20 if wide else 12) :][:4], "big") or 1000
    length = int.from_bytes(data[at + (24 if wide else 16) :][: 8 if wide else 4], "big")
    return scale, length / scale


def read_mp4(data: bytes) -> tuple[list[tuple[float, str]], float]:
    """(chapters, seconds) of an audio book; one without chapters fails."""
    found = _inside(data, b"moov", b"udta", b"chpl")
    if found is None:
        raise ValueError("no chapters in this container")
    scale, length = _clock(data)
    return read_chapter_atom(data[found[2] : found[3]], scale), length


def _atom(name: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content) + 8) + name + content


def with_chapters(data: bytes, chapters: list[tuple[float, str]]) -> bytes:
    """The container with its chapter atom replaced or added; the offsets of its sound follow."""
    moov = _inside(data, b"moov")
    if moov is None:
        raise ValueError("no movie in this container")
    made = _atom(b"chpl", chapter_atom(chapters, _clock(data)[0]))
    kept, user = [], b""
    for name, begin, content, end in atoms(data, moov[2], moov[3]):
        if name == b"udta":
            user = b"".join(data[b:e] for n, b, _, e in atoms(data, content, end) if n != b"chpl")
        else:
            kept.append((name, data[begin:end]))
    new = b"".join(x for _, x in kept) + _atom(b"udta", user + made)
    shift = len(new) + 8 - (moov[3] - moov[1])
    return data[: moov[1]] + _atom(b"moov", _moved(new, shift, moov[3])) + data[moov[3] :]


def _moved(content: bytes, shift: int, behind: int) -> bytes:
    """Atoms whose tables of sample offsets are shifted for what lies behind a place."""
    out = []
    for name, begin, start, end in atoms(content):
        if name in (b"stco", b"co64"):
            width = 4 if name == b"stco" else 8
            n = int.from_bytes(content[start + 4 : start + 8], "big")
            spots = (int.from_bytes(content[start + 8 + i * width :][:width], "big") for i in range(n))
            out.append(_atom(name, content[start : start + 8] + b"".join((x + shift if x >= behind else x).to_bytes(width, "big") for x in spots)))
        elif name in _HOLDERS and name != b"udta":
            out.append(_atom(name, _moved(content[start:end], shift, behind)))
        else:
            out.append(content[begin:end])
    return b"".join(out)
