"""Suffix-array dedup: mark every byte that lies in a long string which also starts elsewhere.

Any two equal strings of ``length`` bytes choose the same anchor, the least hash among their 16-byte
grams (a minimizer), so a repeat shows as an anchor that occurs twice. Anchors that occur once are
dropped. An occurrence's context is what the windows around it can reach:

* occurrences with the same context cover it whole; that is a count, pre-aggregated before the
  shuffle, and takes care of copies however many there are;
* the distinct contexts of one anchor form a small repetitive collection. They go into a run-length
  index (``runindex``), whose streamed matching statistics mark the long matches between them.

An anchor with more than ``group_rows`` distinct contexts is split, not cut: a window that contains
the anchor reaches at least half of the missing bytes to its right or to its left, so each context
goes to two smaller collections, named by the anchor grown by that half to either side, and keeps what
the windows there can reach. Contexts that have become equal are counted as before, and one of them
goes on. Growth ends at whole windows.

Matches never cross documents; texts are judged as UTF-8 bytes, as they are in the input. Contexts
are compared by their bytes inside an index and by 64-bit hashes within an anchor elsewhere.

Edge cases: a null or empty text has no bytes; texts shorter than ``length`` have no repeats;
repeated rows repeat each other, so they are covered whole if long enough, and count once where
contexts are read; ids may be null or occur with several texts, as rows are told apart by id and a
64-bit hash of the text; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import Scratch, text_slices, texts_of, utf8_bytes
from quire.llm.runindex import MAX_TEXT, long_matches

GRAM = 16
_U = np.uint64
_POS = 22


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on (those that reach past the end are void)."""
    h = (data.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    factor, step = 0xBF58476D1CE4E5B9, 1
    while step < GRAM:
        h ^= h >> _U(29)
        grown = h * _U(factor)
        grown[:-step] += h[step:]
        h, factor, step = grown, factor * factor + 2 & 0xFFFFFFFFFFFFFFFF | 1, step * 2
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_hash(column: str) -> Column:
    """A 64-bit hash of a text, a null being an empty one."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the minimizers of all windows of ``length`` bytes inside one text."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    low = (h >> _U(_POS) << _U(_POS)) | np.arange(n, dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    chosen = np.zeros(n, bool)
    valid = np.flatnonzero(np.cumsum(inside[:n])[: len(low)])
    chosen[(low[valid] & _U((1 << _POS) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, h[at]


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, doc_id, th, pos, rt): each anchor, its context's hash, place, and bytes from there on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                data, offsets = utf8_bytes(part.column(1))
                if len(data) >= 1 << _POS:
                    pieces = _long_text(data, length)
                else:
                    pieces = [anchors(data, offsets, length)]
                at = np.concatenate([p[0] for p in pieces])
                h = np.concatenate([p[1] for p in pieces])
                doc = np.searchsorted(offsets, at, side="right") - 1
                left = np.minimum(at - offsets[doc], reach)
                right = np.minimum(offsets[doc + 1] - at, length)
                view = memoryview(data)
                c = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a - x : a + y], x) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist())),
                    np.uint64,
                    len(at),
                )
                sums = np.fromiter((xxhash.xxh64_intdigest(view[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(c.view(np.int64)),
                        part.column(0).take(pa.array(doc)),
                        pa.array(sums[doc].view(np.int64)),
                        pa.array((at - offsets[doc]).astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                    ],
                    names=["h", "c", "doc_id", "th", "pos", "rt"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"h bigint, c bigint, doc_id {kind}, th bigint, pos int, rt int")


def _long_text(data: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Anchors of one text over the size of a sort key's place, from overlapping stretches."""
    out, step = [], 1 << (_POS - 1)
    for start in range(0, max(1, len(data) - length + 1), step):
        part = data[start : start + step + length - 1]
        at, h = anchors(part, np.array([0, len(part)]), length)
        out.append((at + start, h))
    at, first = np.unique(np.concatenate([p[0] for p in out]), return_index=True)
    return [(at, np.concatenate([p[1] for p in out])[first])]


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts: (key, doc_id, th, lo, core, want, ctx), ``core`` inside ``ctx``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Of equal rows one is read; a task drops copies before the shuffle, and both sides are dealt by the same keys.
    same = [F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.col("doc_id").isNull().alias("none"), "th"]
    places = wanted.select(*same, F.struct("h", "pos", "rt", "want").alias("place")).groupBy("id", "none", "th").agg(F.collect_list("place").alias("places"))
    once = docs.withColumn("th", text_hash("text")).select(*same, "text").groupBy("id", "none", "th").agg(F.first("text").alias("text"))
    joined = places.join(once, ["id", "none", "th"]).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "th", "places", "text")
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                lists = part.column(2)
                places, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                h, pos, rt, want = (places.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
                data, offsets = utf8_bytes(part.column(3))
                view = memoryview(data)
                lo = np.maximum(pos.astype(np.int64) - reach, 0)
                begin, end = offsets[doc] + lo, offsets[doc] + pos + rt
                ctx = [bytes(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                for i in range(0, len(ctx), 8192):
                    j = slice(i, i + 8192)
                    at = pa.array(doc[j])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[j]),
                            part.column(0).take(at),
                            part.column(1).take(at),
                            pa.array(lo[j].astype(np.int32)),
                            pa.array((pos[j] - lo[j]).astype(np.int32)),
                            pa.array(np.full(len(lo[j]), GRAM, np.int32)),
                            pa.array(want[j], pa.bool_()),
                            pa.array(ctx[j], pa.binary()),
                        ],
                        names=["key", "doc_id", "th", "lo", "core", "size", "want", "ctx"],
                    )

    return joined.mapInArrow(run, f"key bigint, doc_id {kind}, th bigint, lo int, core int, size int, want boolean, ctx binary")


def _grow(items: DataFrame, length: int) -> DataFrame:
    """Each item of an overfull collection as up to two items with a grown core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ctx, lo, core, size = row["ctx"], row["lo"], row["core"], row["size"]
                more = -(-(length - size) // 2)
                # A core of full length is all that is left of its context: equal ones have been counted.
                for a, b in () if more <= 0 else ((core, core + size + more), (core - more, core + size)):
                    if a >= 0 and b <= len(ctx):
                        first, last = max(0, b - length), min(len(ctx), a + length)
                        if last - first < length:
                            continue
                        name = xxhash.xxh3_64_intdigest(ctx[a:b], (row["key"] ^ (a < core)) & 0xFFFFFFFFFFFFFFFF)
                        rows.append(
                            row | {"key": name - (1 << 63), "lo": lo + first, "core": a - first, "size": b - a, "ctx": ctx[first:last]}
                        )
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return items.mapInArrow(run, items.schema)


def _indexed(items: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, a, b): long matches among the items of each key, found by run-length indexes."""
    kind = items.schema["doc_id"].dataType.simpleString()

    def flush(groups: list[list[tuple]]) -> Iterator[tuple]:
        strings, names, where = [], [], []
        for g, rows in enumerate(groups):
            for doc, th, lo, want, ctx in _merged(rows):
                strings.append(ctx)
                names.append(g)
                where.append((doc, th, lo, want))
        for i, a, b in long_matches(strings, np.array(names), length):
            doc, th, lo, want = where[i]
            if want:
                yield doc, th, lo + a, lo + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        groups: list[list[tuple]] = []
        rows: list[tuple] = []
        current, size, own = None, 0, 0

        def emit() -> pa.RecordBatch:
            found = list(flush(groups))
            cols = list(zip(*found)) or [(), (), (), ()]
            kinds = (schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "th", "a", "b"])

        for batch in batches:
            schema = batch.schema
            for key, *row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "doc_id", "th", "lo", "want", "ctx"))):
                if key != current:
                    if size + own >= MAX_TEXT or len(groups) >= 4000:
                        yield emit()
                        groups, size = [], 0
                    if rows:
                        groups.append(rows)
                        size += own
                    current, rows, own = key, [], 0
                rows.append(tuple(row))
                own += len(row[-1]) + 1
        if size + own >= MAX_TEXT:
            yield emit()
            groups = []
        if rows:
            groups.append(rows)
            yield emit()

    cols = ["key", "doc_id", "th", "lo", "want", "ctx"]
    dealt = items.select(*cols).repartition("key").sortWithinPartitions("key", "doc_id", "th", "lo")
    return dealt.mapInArrow(run, f"doc_id {kind}, th bigint, a int, b int")


def _merged(rows: list[tuple]) -> Iterator[tuple]:
    """Contexts of one text that overlap, made one: no place may stand in an index twice."""
    last = None
    for row in rows:
        if last and row[:2] == last[:2] and row[2] <= last[2] + len(last[4]):
            over = last[2] + len(last[4]) - row[2]
            last = (*last[:3], last[3] or row[3], last[4] + row[4][over:] if over < len(row[4]) else last[4])
        else:
            if last:
                yield last
            last = row
    if last:
        yield last


def repeat_spans(docs: DataFrame, length: int = 200, group_rows: int = 2500, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, a, b): byte ranges that cover exactly the repeated bytes; they may overlap.

    ``docs(doc_id, text)``; ``th`` is the text's hash.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    group_rows = max(2, min(group_rows, MAX_TEXT // (2 * length)))  # a context has less than 2 * length bytes
    occ = scratch.put(occurrences(docs, length), "occ")
    # Keys of joins are tables of their own: only a join between two plain exchanges can be split.
    often = scratch.put(occ.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    again = scratch.put(occ.join(often, "h", "left_semi"), "again")
    scratch.drop("occ")
    pairs = again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "rt")).alias("o"))
    pairs = scratch.put(pairs, "pairs")
    whole = again.join(pairs.where("n > 1").select("h", "c"), ["h", "c"]).select(
        "doc_id", "th", F.greatest(F.col("pos") - (length - GRAM), F.lit(0)).alias("a"), (F.col("pos") + F.col("rt")).alias("b")
    )
    # A context shorter than a window covers nothing.
    whole = whole.where(F.col("b") - F.col("a") >= length)
    mixed = pairs.groupBy("h").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("h")
    mixed = scratch.put(mixed, "mixed")
    wanted = pairs.join(mixed, "h").select("h", "o.*", (F.col("n") == 1).alias("want"))
    items = scratch.put(_contexts(docs, wanted, length), "items")
    found, level = [whole], 0
    while True:
        sizes = scratch.put(items.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        fit = sizes.where(F.col("n") <= group_rows).select("key")
        found.append(scratch.put(_indexed(items.join(fit, "key", "left_semi"), length), f"found{level}"))
        over = sizes.where(F.col("n") > group_rows).select("key")
        if over.isEmpty():
            break
        level += 1
        if level > length.bit_length() + 1:
            raise RuntimeError("collections don't become smaller by growth")
        grown = scratch.put(_grow(items.join(over, "key", "left_semi"), length).withColumn("cx", F.xxhash64("ctx")), f"grown{level}")
        same = ["key", "core", "cx"]
        counted = grown.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("o"))
        counted = scratch.put(counted, f"counted{level}")
        # Equal contexts cover themselves; one of each goes on, as text for the others.
        covered = grown.where("want").join(counted.where("n > 1").select(*same), same)
        found.append(covered.select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("ctx")).alias("b")))
        first = (F.col("doc_id").eqNullSafe(F.col("o.doc_id"))) & (F.col("th") == F.col("o.th")) & (F.col("lo") == F.col("o.lo"))
        kept = grown.join(counted, same).where(first).withColumn("want", F.col("want") & (F.col("n") == 1))
        items = scratch.put(kept.select("key", "doc_id", "th", "lo", "core", "size", "want", "ctx"), f"items{level}")
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), length: int = 200, group_rows: int = 2500,
    as_text: bool = False,
) -> DataFrame:
    """(doc_id, *keep, n_bytes, n_removed, spans, kept) for every row.

    ``spans``: the maximal removed runs as (start, end) in bytes; ``kept``: the other bytes, or with
    ``as_text`` a string of them, without characters that a run cuts in two.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeat_spans(narrow, length, group_rows, scratch)
    listed = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    listed = scratch.put(listed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans"), "listed")
    scratch.keep("listed")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *keep]
    keyed = docs.select(
        F.col(id_col).alias("__id"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.coalesce(text_col, F.lit("")).alias("__text")
    ).withColumn("__th", text_hash("__text"))
    joined = keyed.join(listed, F.col("__id").eqNullSafe(F.col("d")) & (F.col("__th") == F.col("t")), "left")
    joined = joined.select("__id", *(f"__k{i}" for i in range(len(keep))), "__text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 4 << 20):
                at = len(names)
                lists = part.column(at + 1)
                sizes, removed, runs, kept = [], [], [], []
                flat, lens = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                first, last = (flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in (0, 1)) if len(flat) else ([], [])
                i = 0
                for text, k in zip(texts_of(part.column(at)), lens.tolist()):
                    own: list[list[int]] = []
                    for a, b in zip(first[i : i + k], last[i : i + k]):
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], b)
                        else:
                            own.append([a, b])
                    i += k
                    edges = [0, *(x for run_ in own for x in run_), len(text)]
                    kept.append(b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)) if own else text)
                    sizes.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                    runs.append([{"start": a, "end": b} for a, b in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(j) for j in range(at)),
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                    ],
                    names=[*names, "n_bytes", "n_removed", "spans", "kept"],
                )

    schema = ", ".join([f"doc_id {kind}", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])
    return joined.mapInArrow(run, schema + ", n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept " + ("string" if as_text else "binary"))
