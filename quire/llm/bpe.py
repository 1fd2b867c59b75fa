"""BPE encoding and decoding with content-defined chunks that are encoded once.

A text is cut where a rolling hash of its bytes meets a mask, so equal passages are cut alike
wherever they stand. The inside of a chunk runs from its first to its last safe point: a space
between two characters that aren't white space, where the tokenizer's splitting pattern should begin a
new piece whatever surrounds it. A chunk's inside is encoded once and reused by every document of
the task that shares it. The joins are repaired: what lies between the last safe point of a chunk
and the first of the next is encoded together with a piece of the chunks on both sides. Where the ids of these pieces agree
with the chunks' own, those in between are the join's; where they don't, more of both
sides is encoded again, up to the whole text. The ids are then exactly those of the whole text.

Documents are dealt to tasks by their smallest chunk hash, so copies and near copies meet in one
task; the exchange is a rebalancing one, which Spark splits where one key has too many rows.

Encoding uses the rank table of the same vocabulary (checked against the tokenizer's file when it
is loaded); strings with a special token go through the tokenizers library itself. Decoding maps
ids back to bytes and reads them as UTF-8.

Edge cases: a null text is taken as empty and has no ids; texts without any safe point are encoded
whole, however long; repeated rows keep a row each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import text_slices, utf8_bytes

#: Splits text before the merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = ~_SPACE & (np.arange(256) < 128) & (np.arange(256) > 32)
#: White space outside ASCII begins with one of these bytes, so no other character outside ASCII is white space.
_DOUBTFUL = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


class Codec:
    """A byte-level vocabulary: encode to unsigned 32-bit ids, decode to text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the merges of this vocabulary aren't in the order of their ids")
        self.special = [s for s in special]
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = {**{i: w for w, i in ranks.items()}, **{i: s.encode() for s, i in special.items()}}
        self.words = [words.get(i, b"") for i in range(max(words) + 1)]
        self.widths = [len(w) for w in self.words]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return _pack(self.exact.encode(text, add_special_tokens=False).ids)
        if _CROWDED.search(text):
            return _pack(self.fast.encode_ordinary(text))
        # White space is single spaces and line feeds between other characters: each begins a new piece.
        found = []
        for i, word in enumerate(text.split(" ")):
            word = " " + word if i else word
            got = self.known.get(word)
            if got is None:
                if "\n" in word:
                    head, *rest = word.split("\n")
                    got = self._word(head) + b"".join(self._word("\n") + self._word(x) for x in rest)
                else:
                    got = self._word(word)
            found.append(got)
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = _pack(self.fast.encode_ordinary(word))
            if len(word) <= 40:
                if len(self.known) >= _WORDS:
                    self.known.clear()
                self.known[word] = got
        return got

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, array("I", packed)))


#: White space that isn't a single space or line feed between other characters, an initial space aside.
_CROWDED = re.compile(r"\s\s|[^\S \n]|^\n|\s\Z")
#: Words that a worker remembers.
_WORDS = 300_000


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 bytes stand for themselves; the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def rolling_hash(data: np.ndarray, span: int = 16) -> np.ndarray:
    """For each byte a hash of it and the bytes before it, ``span`` of them (a power of two)."""
    mix = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    step, factor = 1, 0x9E3779B1
    while step < span:
        shifted = np.zeros_like(mix)
        shifted[step:] = mix[:-step]
        mix = (mix ^ (mix >> np.uint32(15))) + shifted * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    return mix ^ (mix >> np.uint32(13))


def chunk_cuts(data: np.ndarray, offsets: np.ndarray, mask: int = 0x3FF, span: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(positions where chunks end inside a text, safe points), both sorted."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((rolling_hash(data, span) & np.uint32(mask)) == 0) + 1
    text = np.searchsorted(offsets, cut - 1, side="right") - 1
    cut = cut[(cut - offsets[text] >= span) & (cut < offsets[text + 1])]
    safe = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[safe - 1], data[safe + 1]
    # The character before: of one byte, or of several whose first isn't doubtful.
    wide = (before >= 128) & ~((data[np.maximum(safe - 2, 0)] == 0xC2) | _DOUBTFUL[data[np.maximum(safe - 3, 0)]])
    safe = safe[(_PLAIN[before] | wide) & (_PLAIN[after] | ((after > 0xC2) & ~_DOUBTFUL[after]))]
    edge = np.concatenate((offsets, offsets - 1))
    return cut, safe[~np.isin(safe, edge)]


def pieces(start: int, end: int, cuts: np.ndarray, safe: np.ndarray) -> list[tuple[int, int, bool]]:
    """A text's parts in order as (start, end, is a chunk's inside); all inner borders are safe points."""
    out, at, low = [], start, start
    for cut in [*cuts[np.searchsorted(cuts, start, "right") : np.searchsorted(cuts, end, "left")].tolist(), end]:
        a, b = np.searchsorted(safe, low, "left"), np.searchsorted(safe, cut, "left")
        if b - a >= 2:
            first, last = int(safe[a]), int(safe[b - 1])
            if first > at:
                out.append((at, first, False))
            out.append((first, last, True))
            at = last
        low = cut
    if at < end:
        out.append((at, end, False))
    return out


def _split(tool: Codec, coded: array, length: int) -> int:
    """How many ids at the start stand for exactly ``length`` bytes; -1 if none do."""
    n = done = 0
    while done < length and n < len(coded):
        done += tool.widths[coded[n]]
        n += 1
    return n if done == length else -1


def joined(tool: Codec, view: memoryview, a: int, b: int, left: tuple[int, bytes] | None, right: tuple[int, bytes] | None, safe: np.ndarray) -> bytes | None:
    """The ids of the join [a, b) between two chunks' insides, given as (their far end, their ids).

    None where its ids never agree with the chunks' own.
    """
    i, j = np.searchsorted(safe, a, "left"), np.searchsorted(safe, b, "left")
    reach = 1
    while True:
        low = a if left is None else max(left[0], int(safe[max(0, i - reach)]))
        high = b if right is None else min(right[0], int(safe[min(len(safe) - 1, j + reach)]))
        raw = tool.encode(bytes(view[low:high]).decode())
        coded = array("I", raw)
        m = _split(tool, coded, a - low)
        n = m + _split(tool, coded[m:], b - a) if m >= 0 else -1
        if n >= m >= 0 and (left is None or left[1].endswith(raw[: 4 * m])) and (right is None or right[1].startswith(raw[4 * n :])):
            return raw[4 * m : 4 * n]
        if (left is None or low == left[0]) and (right is None or high == right[0]):
            return None
        reach *= 4


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the smallest chunk hash of their text, dealt out by it."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                data, offsets = utf8_bytes(part.column(1))
                hashed = rolling_hash(data)
                keys = np.zeros(part.num_rows, np.int64)
                full = np.diff(offsets) > 0
                if full.any():
                    keys[full] = np.minimum.reduceat(hashed, offsets[:-1][full])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys)], names=["doc_id", "text", "k"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(key, f"doc_id {kind}, text string, k bigint").hint("rebalance", F.col("k")).select("doc_id", "text")


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 48 << 20, mask: int = 0x3FF
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids packed as little-endian unsigned 32-bit integers.

    ``cache_bytes`` bounds what a task keeps of encoded chunks; beyond it the oldest go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        known: dict[bytes, bytes] = {}
        held = 0

        def inside(tool: Codec, view: memoryview, a: int, b: int) -> bytes:
            """The ids of a chunk's inside, encoded once."""
            nonlocal held
            raw = bytes(view[a:b])
            name = raw if len(raw) <= 16 else xxhash.xxh3_128_digest(raw)
            got = known.get(name)
            if got is None:
                got = known[name] = tool.encode(raw.decode())
                held += len(got) + 150
                while held > cache_bytes:
                    held -= len(known.pop(next(iter(known)))) + 150
            return got

        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                data, offsets = utf8_bytes(part.column(1))
                cuts, safe = chunk_cuts(data, offsets, mask)
                view = memoryview(data)
                ids, texts = [], []
                for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    parts = pieces(start, end, cuts, safe)
                    coded = [inside(tool, view, a, b) if shared else None for a, b, shared in parts]
                    for k, (a, b, shared) in enumerate(parts):
                        if not shared:
                            left = (parts[k - 1][0], coded[k - 1]) if k else None
                            right = (parts[k + 1][1], coded[k + 1]) if k + 1 < len(parts) else None
                            coded[k] = joined(tool, view, a, b, left, right, safe)
                    ids.append(tool.encode(bytes(view[start:end]).decode()) if None in coded else b"".join(coded))
                    texts.append(tool.decode_bytes(ids[-1]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = _dealt(docs, id_col, text_col)
    return dealt.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def decode_ids(packed: bytes, vocabulary: str) -> str:
    """The text of packed ids."""
    return codec(vocabulary).decode_bytes(packed).decode("utf-8", "replace")
