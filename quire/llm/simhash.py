"""SimHash near-duplicates found through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit count of each segment is one
coordinate. The Manhattan distance between two such vectors is a lower bound of the Hamming
distance of the fingerprints. Coordinates are held in unary (0, 1, 2 as 00, 01, 11), so the whole
vector is one long and the Manhattan distance is the bit count of an exclusive or.

The range join runs over a grid: the 32 coordinates form four blocks, and vectors at distance two
or less agree on at least two blocks. A cell is a pair of blocks with their coordinates; fingerprints
meet in their six cells, are compared by the lower bound first, and then verified exactly. A cell
with more than ``dense`` distinct fingerprints isn't compared pairwise: its members meet at their
65 fingerprints at distance one or less, where all that meet are linked (two fingerprints at
distance two have a common neighbour at distance one), which is exact and linear.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle form one shingle; repeated rows keep one output row each; a null doc_id never
becomes a component id unless the whole class has none; an empty table gives an empty result. Only
the named columns are read, so further columns may carry any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import Scratch, text_slices, texts_of
from quire.llm.components import connected_components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_LANES = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_EVEN = 0x5555555555555555
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return fingerprint(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=n))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n = len(hashes)
    counts = np.zeros((8, 8))
    for i in range(0, n, _CHUNK):
        lanes = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", 4 << 20):
                found = [simhash(t, shingle) for t in texts_of(part.column(1))]
                fp = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _unary(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint, two unary bits each."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _cells(emb: Column) -> Column:
    def block(i: int) -> Column:
        return F.shiftrightunsigned(emb, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))

    return F.array(
        *(
            F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j))
            for k, (i, j) in enumerate(combinations(range(4), 2))
        )
    )


def links(fps: DataFrame, dense: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fps(fp)`` that differ in one or two bits.

    Cells with up to ``dense`` members give all their links; denser ones give enough links to
    connect exactly what the full set would connect.
    """
    scratch = scratch or Scratch(fps.sparkSession, "simhash")
    emb = fps.select("fp", _unary(F.col("fp")).alias("emb"))
    cells = scratch.put(emb.select("fp", "emb", F.explode(_cells(F.col("emb"))).alias("cell")), "cells")
    sizes = scratch.put(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    few = cells.join(sizes.where(F.col("n") <= dense).select("cell"), "cell")
    few = scratch.put(few, "few")
    left, right = few.alias("a"), few.alias("b")
    pairs = left.join(
        right,
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.emb").bitwiseXOR(F.col("b.emb"))) <= 2)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = cells.join(sizes.where(F.col("n") > dense).select("cell"), "cell").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    near = scratch.put(near, "near")
    heads = near.groupBy("mid").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(heads, "mid").where("fp <> head").select(F.col("head").alias("u"), F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, dense: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component is its smallest reachable doc_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col, shingle), "fps")
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = scratch.put(connected_components(links(distinct.select("fp"), dense, scratch), scratch), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.put(named.join(least, "root").select("fp", "component_id"), "named")
    scratch.keep("fps", "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
