"""Near copies by the Jaccard similarity of word shingles: SimHash finds the nearest, an exact join of candidates the rest.

Two texts are copies if the sets of their five-word shingles (lowered ASCII, split at white space; fewer
words form one shingle) have a Jaccard similarity of 0.8 or more. Components of that relation are
found over distinct word sequences, and no link of it is left to chance.

SimHash fingerprints of the shingles meet in the segment-popcount grid (``simhash.links``), which finds the nearest copies with
no look at their sets; those pairs are then decided on their sets. At a similarity of 0.8 fingerprints of 64 bits differ in about ten
bits, a radius at which no grid is selective, so the links that are left come from the candidates of ``ngramjoin``: texts that share one
of their rarest tokens, which every pair at 0.8 does. Texts that SimHash has joined are passed over there. What unlike texts share with many others
isn't among their rarest tokens, so templates don't make candidates of all pairs.

Edge cases: null, empty and blank texts are copies of each other; repeated rows keep a row each, whatever their ids; texts of any
length are compared whole; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import ngramjoin, simhash
from quire.llm.common import Scratch, text_slices, texts_of

SHINGLE, PERCENT = 5, 80


def nodes(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, text, node): the hash of every text's word sequence."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "text", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__t", 4 << 20):
                column = part.column(len(keep))
                found = [ngramjoin.word_hash(t.lower().split()) for t in texts_of(column)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), column, pa.array(found, pa.int64())], names=names)

    return docs.select(*keep, F.col(text_col).alias("__t")).mapInArrow(run, f"{kinds}, text string, node bigint")


def fingerprint_pairs(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): texts of ``prints(node, fp)`` whose fingerprints the segment-popcount grid links, by the least text of each fingerprint."""
    heads = scratch.put(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads_of_prints")
    linked = simhash.links(heads.select("fp"), scratch=scratch)
    across = linked.join(heads.toDF("u", "hu"), "u").join(heads.toDF("v", "hv"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    return across.union(prints.join(heads, "fp").where("node <> head").select("head", "node"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets link; a text without a set has no links at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(texts_of(batch.column(2)), texts_of(batch.column(3))):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                good.append(ngramjoin.similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    a = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def components(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, tile: int = ngramjoin.TILE) -> DataFrame:
    """(*keep, text, root) for every row; rows of one component have one root."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    rows = scratch.put(nodes(docs, text_col, keep), "rows")
    texts = rows.select(F.col("node").alias("doc_id"), F.col("text").alias("t"))
    parsed = scratch.put(ngramjoin.parsed_texts(texts, percent, SHINGLE, prints=True), "parsed")
    prints = scratch.put(parsed.where("n > 0").select("node", "fp").distinct(), "all_prints")
    lots = ngramjoin.candidates(parsed, scratch)
    scratch.drop("parsed")
    sets = scratch.put(ngramjoin.sets_of(texts, lots, SHINGLE), "sets")
    prints = prints.join(sets.select("node"), "node", "left_semi")
    near = fingerprint_pairs(scratch.put(prints, "prints"), scratch)
    pairs = scratch.put(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    known = scratch.put(verified(pairs, sets, percent), "known")
    roots = ngramjoin.joined(sets, scratch, percent, tile, known)
    roots = scratch.put(roots, "named")
    scratch.keep("rows", "named")
    return rows.join(roots, "node", "left").select(*keep, "text", F.coalesce("root", "node").alias("root"))
