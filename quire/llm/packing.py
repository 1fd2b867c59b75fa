"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A text is cut into pieces of at most ``capacity`` bytes, never inside a character. Pieces go to bins
in decreasing order of length. A bin carries a bitmap of the sources and one of the duplicate
clusters it already holds; a piece fits only where neither bit is set. Bins are ordered by residual:
the search takes the smallest residual that suffices, and goes on to the next larger one until a
compatible bin is found; if there is none, a bin is opened. Full pieces of long texts fill bins of
their own at once.

Rows are dealt to groups of about ``group_rows`` rows by a hash of id and text; groups are packed
independently, so memory is bounded and a source or cluster may hold any share of the rows. Then the pieces of all
groups' open bins (less than ``FULL`` of the capacity) are dealt anew and packed again, so pieces of different groups
meet, until they fit into one group or most of them stay in open bins, as where one source needs a bin for each of its pieces.

Edge cases: null and empty texts give one row with piece_bytes 0 and no bin; null sources and null
clusters conflict with nothing; repeated rows belong to one cluster, so they lie in different bins;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import Scratch, text_slices

CAPACITY = 8192
#: A bin that holds less than this share is open.
FULL = 0.9
PIECE = ("doc_id", "source", "cluster", "check", "piece", "start", "size")


class Packer:
    """Bins of one group, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.filled = 0  # bit r: some bin has residual r
        self.total: dict[int, int] = defaultdict(int)
        self.holding: dict[tuple[int, int], int] = defaultdict(int)  # (source bit, residual) to the number of bins that hold the source
        self.copies: dict[tuple[int, int], int] = defaultdict(int)  # the same of clusters
        self.by_mask: dict[int, dict[int, dict[int, None]]] = defaultdict(lambda: defaultdict(dict))
        self.clusters: list[int] = []
        self.bits: dict[str, dict[object, int]] = {"source": {}, "cluster": {}}
        self.used: list[int] = []

    def bit(self, kind: str, value: object) -> int:
        """A value's bit in its bitmap; -1 for null."""
        own = self.bits[kind]
        return -1 if value is None else own.setdefault(value, len(own))

    def _put(self, bin_: int, residual: int, mask: int) -> None:
        if residual <= 0:
            return
        self.filled |= 1 << residual
        self.total[residual] += 1
        self.by_mask[residual][mask][bin_] = None
        self._count(bin_, residual, mask, 1)

    def _take(self, bin_: int, residual: int, mask: int) -> None:
        bins = self.by_mask[residual][mask]
        del bins[bin_]
        if not bins:
            del self.by_mask[residual][mask]
        self.total[residual] -= 1
        if not self.total[residual]:
            self.filled &= ~(1 << residual)
        self._count(bin_, residual, mask, -1)

    def _count(self, bin_: int, residual: int, mask: int, by: int) -> None:
        for held, bits in ((self.holding, mask), (self.copies, self.clusters[bin_])):
            while bits:
                low = bits & -bits
                held[low.bit_length() - 1, residual] += by
                bits ^= low

    def add(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, offset) of a piece in the tightest compatible bin."""
        s, c = self.bit("source", source), self.bit("cluster", cluster)
        own, copy = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        ahead = self.filled >> size
        residual = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            residual += step
            # A residual is passed over if all its bins hold the source, or all hold the cluster.
            if self.total[residual] > max(self.holding.get((s, residual), 0), self.copies.get((c, residual), 0)):
                for mask, bins in self.by_mask[residual].items():
                    if mask & own:
                        continue
                    for bin_ in bins:
                        if not self.clusters[bin_] & copy:
                            self._take(bin_, residual, mask)
                            self.clusters[bin_] |= copy
                            self._put(bin_, residual - size, mask | own)
                            self.used[bin_] += size
                            return bin_, self.used[bin_] - size
            ahead >>= step + 1
            residual += 1
        bin_ = len(self.used)
        self.used.append(size)
        self.clusters.append(copy)
        self._put(bin_, self.capacity - size, own)
        return bin_, 0


def cut_points(text: bytes, capacity: int) -> list[int]:
    """Ends of the pieces of a text, at character borders."""
    ends, at = [], 0
    while len(text) - at > capacity:
        end = at + capacity
        while text[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(text)]


def pack(
    docs: DataFrame,
    cluster: Column,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    group_rows: int = 20000,
) -> DataFrame:
    """(doc_id, piece, start_byte, piece_bytes, bin_id, bin_offset, source): a row for each piece.

    ``bin_id`` is unique over all groups. ``cluster`` names the duplicate cluster of a row.
    """
    if capacity < 4:
        raise ValueError("a capacity below four bytes can't hold every character")
    scratch = Scratch(docs.sparkSession, "packing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(source_col).alias("source"), cluster.alias("cluster"))
    rows = scratch.put(_piece_ends(narrow, capacity), "pieces")
    left, level, done = rows.count(), 0, []
    while True:
        groups = max(1, -(-left // group_rows))
        placed = _packed(rows, capacity, groups, level)
        if groups == 1:
            done.append(placed)
            break
        placed = scratch.put(placed, f"placed{level}")
        opened = F.coalesce(F.col("used") < capacity * FULL, F.lit(False))
        before, left = left, placed.where(opened).count()
        if not left or 2 * left > before:
            done.append(placed)
            break
        done.append(placed.where(~opened))
        rows = placed.where(opened)
        level += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    names = {"start": "start_byte", "size": "piece_bytes"}
    return found.select(*(F.col(c).alias(names.get(c, c)) for c in ("doc_id", "piece", "start", "size", "bin_id", "bin_offset", "source")))


def _packed(rows: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """The pieces with their bins and what these hold (``used``), each of ``groups`` groups packed by itself."""
    dealt = rows.select(*PIECE).withColumn("group", F.pmod(F.xxhash64("doc_id", "check", F.lit(level)), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(groups, "group").sortWithinPartitions("group", F.desc("size"), "doc_id", "check", "start")

    def emit(parts: list[pa.RecordBatch], group: int, bins: list, offsets: list, packer: Packer) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        used = [None if b is None else packer.used[b] for b in bins]
        names = [None if b is None else (level << 56) + (group << 32) + b for b in bins]
        arrays = [*(whole.column(i) for i in range(len(PIECE))), pa.array(names, pa.int64()), pa.array(offsets, pa.int32()), pa.array(used, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=[*PIECE, "bin_id", "bin_offset", "used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer, parts, bins, offsets = None, Packer(capacity), [], [], []
        at = {n: i for i, n in enumerate([*PIECE, "group"])}
        for batch in batches:
            keys = batch.column(at["group"]).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if keys[a] != current:
                    if parts:
                        yield emit(parts, current, bins, offsets, packer)
                    current, packer, parts, bins, offsets = int(keys[a]), Packer(capacity), [], [], []
                part = batch.slice(a, b - a)
                parts.append(part)
                for size, source, name in zip(*(part.column(at[n]).to_pylist() for n in ("size", "source", "cluster"))):
                    bin_, offset = packer.add(size, source, name) if size else (None, None)
                    bins.append(bin_)
                    offsets.append(offset)
        if parts:
            yield emit(parts, current, bins, offsets, packer)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*PIECE).schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, bin_id bigint, bin_offset int, used int")


def _piece_ends(rows: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, source, cluster, check, piece, start, size): texts stay behind."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    short = F.octet_length("text") <= capacity
    base = [F.col("doc_id"), F.col("source"), F.col("cluster"), F.crc32("text").alias("check")]
    whole = rows.select(*base, F.when(short, F.lit(None)).otherwise(F.col("text")).alias("text"), F.octet_length("text").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text", 8 << 20)):
            at, piece, start, size = [], [], [], []
            sizes = batch.column(5).to_pylist()
            for i, text in enumerate(batch.column(4).to_pylist()):
                last = 0
                for j, end in enumerate([sizes[i]] if text is None else cut_points(text.encode(), capacity)):
                    at.append(i)
                    piece.append(j)
                    start.append(last)
                    size.append(end - last)
                    last = end
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(4)), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                names=["doc_id", "source", "cluster", "check", "piece", "start", "size"],
            )

    return whole.mapInArrow(
        run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, cluster {kinds['cluster']}, check bigint, piece int, start int, size int"
    )
