"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled texts. A text
is parsed greedily into phrases, each the longest match that the sample holds from there on; the
language whose parse needs the fewest phrases, normalised by the sample's size, wins.

The sample: up to ``docs_per_lang`` labelled rows of each language in the order of a hash of the
id, up to ``train_bytes`` normalised bytes a language and ``max_bytes`` in all; of a longer text stretches from all over it, at equal
distances. That bound holds for training only; every text is parsed whole. Normalisation: letters are lower-cased (ASCII and Latin-1), everything else that
is ASCII becomes one space. The parse starts anew every ``block`` bytes, which makes it a fixed
function of the text and lets many blocks advance together through one transition table.

Edge cases: null texts and texts without a letter get ``und`` with score 0; ties go to the smaller
language name; without labelled rows every text is ``und``; texts of any length are parsed whole; an empty table gives an empty result. Repeated rows keep a row each. Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import text_slices, utf8_bytes

UND = "und"
#: Stretches that a long text is sampled by.
STRETCHES = 8
#: Buckets that a label's rows are first ranked in.
BUCKETS = 16


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    return table


_CLASS = _classes()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes mapped to letters or 0, runs of 0 made one, and the new offsets."""
    out = _CLASS[data]
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(upper):
        upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E)]
        out[upper] += 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    inner = offsets[1:-1][offsets[1:-1] < len(out)]
    keep[inner] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@dataclass
class CrossParser:
    """Languages with one joint transition table.

    An entry is four times the next state's row offset, plus the number of phrases that end: one
    where the next phrase begins with this byte, and one for a byte that is a phrase by itself.
    """

    langs: list[str]
    cost: np.ndarray
    code: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    width: int
    block: int = 1024

    @classmethod
    def fit(cls, samples: dict[str, bytes], block: int = 1024) -> CrossParser:
        samples = {k: v for k, v in sorted(samples.items()) if v}
        seen = sorted(set(b"".join(samples.values())))
        code = np.full(256, len(seen), np.uint8)
        code[seen] = np.arange(len(seen))
        width = len(seen) + 1
        rows, roots = [], []
        for text in samples.values():
            moves, base = suffix_automaton(bytes(code[np.frombuffer(text, np.uint8)])), sum(map(len, rows))
            table = np.full((len(moves), width), -1, np.int64)
            for state, out in enumerate(moves):
                table[state, list(out)] = list(out.values())
            first, alone = np.maximum(table[0], 0), table[0] < 0
            ends = 1 + alone[None, :] - np.where(np.arange(len(moves)) == 0, 1, 0)[:, None] * alone[None, :]
            table = np.where(table >= 0, 4 * (table + base) * width, 4 * (first[None, :] + base) * width + ends)
            rows.append(table)
            roots.append(base * width)
        table = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
        kind = np.int32 if 4 * table.size + 4 < 1 << 31 else np.int64
        return cls(
            list(samples),
            np.array([math.log2(max(2, len(v))) for v in samples.values()]),
            code,
            table.astype(kind).ravel(),
            np.array(roots, kind),
            width,
            block,
        )

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a byte that each text costs in each language: (texts, languages)."""
        symbols, ends = normalise(data, offsets)
        symbols = self.code[symbols]
        lengths = np.diff(ends)
        blocks = -(-lengths // self.block)
        doc = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = ends[:-1][doc] + nth * self.block
        size = np.minimum(self.block, ends[1:][doc] - start)
        order = np.argsort(-size, kind="stable")
        start, size, doc = start[order], size[order], doc[order]
        state = np.repeat(self.roots[:, None], len(doc), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = len(doc) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1), side="left")
        for t, k in enumerate(active.tolist()):
            step = self.table[state[:, :k] + symbols[start[:k] + t][None, :]]
            count[:, :k] += step & 3
            state[:, :k] = step >> 2
        count += state != self.roots[:, None]  # the last phrase of a block
        phrases = np.stack([np.bincount(doc, weights=row, minlength=len(lengths)) for row in count], axis=1)
        return phrases * self.cost[None, :] / np.maximum(lengths, 1)[:, None]


def sample_texts(
    docs: DataFrame, label_col: str, id_col: str, text_col: str, docs_per_lang: int, train_bytes: int, max_langs: int, max_bytes: int
) -> dict[str, bytes]:
    """A bounded training text for each label; the rows chosen depend on ids only."""
    keyed = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(F.col(id_col)).alias("h")
    )
    known = keyed.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_langs).select("label")
    # First within buckets of the hash, then among what these leave: a bounded number of rows, whatever a label's share.
    ranked = keyed.distinct()
    for keys in (("label", F.pmod("h", F.lit(BUCKETS))), ("label",)):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
        ranked = ranked.withColumn("r", first).where(F.col("r") <= docs_per_lang).drop("r")
    chosen = ranked.join(F.broadcast(known), "label").select("id", F.col("label").alias("chosen_label"))  # max_langs rows
    width = 4 * train_bytes // docs_per_lang
    text, stretch = F.col("text"), max(1, width // STRETCHES)
    begin = lambda i: (F.floor(i * (F.length("text") - stretch) / (STRETCHES - 1)) + 1).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(text, begin(i), F.lit(stretch))), " ")
    found = (
        docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # docs_per_lang rows of each of max_langs labels
        .where("label = chosen_label and text is not null")
        .select("id", "label", F.when(F.length("text") <= width, text).otherwise(spread).alias("text"))
    )
    # An id may stand in many rows: the bound holds for rows.
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text"))
    rows = found.withColumn("r", nth).where(F.col("r") <= docs_per_lang).select("id", "label", "text").collect()
    out: dict[str, bytearray] = {}
    own = max(1, min(train_bytes, max_bytes // max(1, len({r["label"] for r in rows}))))
    for row in sorted(rows, key=lambda r: (r["label"], r["id"], r["text"])):
        data = np.frombuffer(row["text"].encode(), np.uint8)
        if len(data):
            symbols, _ = normalise(data, np.array([0, len(data)]))
            got = out.setdefault(row["label"], bytearray())
            got += symbols.tobytes()[: max(0, min(4 * own // docs_per_lang, own - len(got)))] + b"\0"
    return {k: bytes(v) for k, v in out.items()}


def train(
    docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_lang: int = 48, train_bytes: int = 16384,
    max_langs: int = 256, max_bytes: int = 1 << 18,
) -> CrossParser:
    """Fit on a bounded sample: at most ``docs_per_lang`` rows and ``train_bytes`` bytes a language, ``max_bytes`` in
    all, of the ``max_langs`` most frequent labels.
    """
    return CrossParser.fit(sample_texts(docs, label_col, id_col, text_col, docs_per_lang, train_bytes, max_langs, max_bytes))


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, bits) for every row.

    ``bits``: the winner's bits a byte. ``score``: by which share the runner-up costs more, 0 to 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(parser)  # train_bytes a language bound its size
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs = np.array([*model.langs, UND], dtype=object)
        for batch in batches:
            for part in text_slices(batch, "__text", 6 << 20):
                column = part.column("__text")
                data, offsets = utf8_bytes(column)
                letter = _letters(data, offsets, column)
                n = part.num_rows
                best, score, bits = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
                if model.langs:
                    cost = model.bits(data, offsets)
                    best = cost.argmin(axis=1)
                    bits = cost.min(axis=1)
                    second = np.partition(cost, 1, axis=1)[:, 1] if cost.shape[1] > 1 else np.full(n, np.inf)
                    score = np.where(np.isinf(second), 1.0, 1.0 - bits / np.maximum(second, 1e-9))
                    best[~letter], score[~letter], bits[~letter] = len(model.langs), 0.0, 0.0
                arrays = [part.column("__text" if name == text_col else name) for name in names]
                arrays += [pa.array(langs[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "lang_pred", "score", "bits"])

    # A kept text column travels once.
    cols = [F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep if c != text_col), F.col(text_col).alias("__text")]
    schema = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, [id_col, *keep]))
    return docs.select(*cols).mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")


def _letters(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which texts hold a letter."""
    low = data | 0x20
    ascii_letter = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))))
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(ch.isalpha() for ch in column[i].as_py() or "")
    return found
