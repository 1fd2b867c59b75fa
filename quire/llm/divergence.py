"""Source divergence audit: how far the sources of a language lie apart in their use of its common terms.

A relational plan. Regular-expression matches are exploded and counted by (language, source, term), with the documents that
hold them; a language keeps the terms of enough documents. Every group (a language and a source) is crossed with its language's
kept terms, which makes zeros counts, and gets a smoothed share of each term in units of 1/SCALE; the shares of one term meet
each other (the self-join on language and term) and the language's own share. Sums and ranks are Spark's.

Matching and the whole-number arithmetic run over Arrow batches: built-in functions need five times the CPU seconds that
the check tool grants. A task pre-aggregates slices of text, so a term or group of a third of all rows is a few numbers a
slice. Rows of a kept term stand together, one row with a count for each source that has it, so the dense rows are a matrix of a
batch and the self-join moves no data: a batch gives one partial sum for each pair. The table of groups has a row for each
source; its join by language is broadcast only where Spark measures it as small, and split as a skewed join elsewhere.

The share is found by long division in steps of a thousand, so no product leaves 64 bits as long as a language has under
9 * 10^15 terms; squares of shares stay below 2 * 10^18, and so do their sums, as the shares of a group add up to little over SCALE.

Edge cases: null texts, languages and sources are read as empty ones; a language without kept terms has value 0 for each pair
of its sources and no term rows; a group without terms takes part with zeros; each repeated row counts as a document; a
language of one source has no pairs; equal values are ranked by the item's bytes; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import Scratch, text_slices, utf8_bytes

#: Letters A to Z in any case and everything beyond ASCII, as bytes: a match is a maximal run of one class.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_INSIDE = np.array([TERM.match(bytes([b])) is not None for b in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # of bytes: A to Z only
SCALE = 1_000_000_000
#: Bytes of text that a task counts at a time.
SLICE = 8 << 20


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)) by long division."""
    whole = total + np.int64(terms)
    found, rest = np.divmod(count + np.int64(1), whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * np.int64(1000), whole)
        found = found * np.int64(1000) + digit
    return found + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def matches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, lowered match) of every match of TERM in texts that stand in a row; none crosses an end."""
    inside = np.concatenate((_INSIDE[data], [False]))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    starts[cuts] = inside[cuts]
    first = np.flatnonzero(starts)
    own = np.flatnonzero(inside)
    ends = np.append(np.searchsorted(own, first), len(own)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[own]])])
    return np.searchsorted(offsets, first, side="right") - 1, words.dictionary_encode()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", SLICE):
                data, offsets = utf8_bytes(part.column(2))
                row, coded = matches(data, offsets)
                terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                if not len(terms):
                    continue
                pair, n = np.unique(row * len(terms) + code, return_counts=True)  # a document's distinct terms
                named = pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["lang", "source"])
                group = _group_numbers(named)
                key, at = np.unique(group[pair // len(terms)] * len(terms) + pair % len(terms), return_inverse=True)
                first = np.zeros(int(group.max()) + 1, np.int64)
                first[group[::-1]] = np.arange(len(group))[::-1]
                of = pa.array(first[key // len(terms)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(of),
                        part.column(1).take(of),
                        terms.take(pa.array(key % len(terms))).cast(pa.binary()).cast(pa.string()),
                        pa.array(np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)),
                        pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    named = (F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "t")))
    each = docs.select(*named).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group_numbers(named: pa.RecordBatch) -> np.ndarray:
    """A small number for each row, equal for equal pairs of its two columns."""
    a, b = (named.column(i).dictionary_encode() for i in (0, 1))
    both = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
    return np.unique(both, return_inverse=True)[1].astype(np.int64)


def _measured(wide: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value) of kept terms: partial sums of the pairs, and terms that a group uses more than its language.

    Of a batch's terms of a group those go on that may still be among the ``top``, with all ties of the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield from measure(lang, batch.take(pa.array(np.flatnonzero(code == i))))

    def measure(lang: str, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups = rows.column(6)[0].as_py()
        sources, totals = [g["source"] for g in groups], np.array([g["total"] for g in groups], np.int64)
        kept, everything = rows.column(4)[0].as_py(), np.int64(rows.column(5)[0].as_py())
        lists = rows.column(3)
        cells, at = lists.flatten(), np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        place = cells.field(0).dictionary_encode()
        of = {s: i for i, s in enumerate(sources)}
        column = np.array([of[s] for s in place.dictionary.to_pylist()], np.int64)[place.indices.to_numpy()]
        count = np.zeros((len(sources), rows.num_rows), np.int64)
        count[column, at] = cells.field(1).to_numpy()
        p = share(count, totals[:, None], kept)
        for i in range(len(sources)):
            value = excess(p[i], p).sum(axis=1)
            other = [j for j in range(len(sources)) if j != i]
            yield found(lang, [sources[i]] * len(other), "pair", pa.array([sources[j] for j in other], pa.string()), value[other])
        q = share(rows.column(2).to_numpy(), everything, kept)
        for i in range(len(sources)):
            t = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = excess(p[i, t], q[t])
            if len(t) > top:
                keep = value >= np.partition(value, len(t) - top)[len(t) - top]
                t, value = t[keep], value[keep]
            yield found(lang, [sources[i]] * len(t), "term", rows.column(1).take(pa.array(t)), value)

    def found(lang: str, source: list | pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(item), np.int64))) for x in (lang, part)]
        return pa.RecordBatch.from_arrays([same[0], pa.array(source, pa.string()), same[1], item, pa.array(value)], names=["lang", "source", "part", "item", "value"])

    cols = wide.select("lang", "term", "all", "counts", "terms", "total", "groups")
    return cols.mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, top: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language, by the divergence from it summed over all kept terms. Part ``term``: the
    ``top`` kept terms that a group uses more than its language does.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = term_counts(docs, lang_col, source_col, text_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = scratch.put(kept.where(F.col("docs") >= least).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    groups = scratch.put(groups, "groups")
    beside = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    beside = scratch.put(langs.join(beside, "lang"), "beside")  # a table of known size: small ones are sent to the terms, not the terms to them
    found = scratch.put(_measured(kept.join(beside, "lang"), top), "found")
    scratch.keep("groups", "found")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("sum"))
    across = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = across.join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("sum", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
