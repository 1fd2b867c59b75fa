"""Repair of the turn structure of conversations at least cost.

A conversation should read as role initials ``(s?(ua)+)?`` without blank, repeated or cut-off turns. Its rows, in order, are
read by the automaton of that grammar, with edits: Keep (0), Rerole to user or assistant (2), Delete (3, required for blank
and duplicate rows), Insert an empty user or assistant turn (2); a truncated row that stays adds 1.

The search is by cost layers in the manner of Wu and Manber: layer c holds for each turn the bitset of grammar states from
which the rest can be accepted at a cost of at most c. A layer follows from the three below it by table look-ups; the first
layer that holds the entry state before the first turn gives the cost. A trace through the bits, trying Delete, Insert, Keep,
Rerole in that order, gives the least of the cheapest audits. Of a layer only the stretch is computed that isn't empty, or full
in the layer below, so time and memory follow the turns, not turns times cost.

Rows stand by turn (nulls first), then role, then text (by its first 24 characters, then a hash). Three streams over sorted partitions:

1. rows without their texts become chunks of a byte a row, with faults and counts; duplicates were found by an aggregate before;
2. chunks, last first: the costs of the states at a chunk's end, a vector of four numbers that is carried from chunk to chunk;
3. texts behind their chunks, first to last: layers of one chunk, its trace, and the running hash of the repaired text.

No stream holds more than a chunk, so a conversation of a third of all rows is sorted on disk and read through. It can't be dealt to
several tasks in the third stream: the contract's SHA-256 of the whole repaired text is serial.

Edge cases: null roles and texts are read as one space, so such a text is blank; a null turn stands first and is left out of gaps; null
conversation ids are one conversation; repeated rows are duplicates; roles are told by their first character, and one that isn't u, a or
s must be deleted or changed; a conversation without rows has zeros, an empty audit and the hash of the empty string; gaps over 64 bits
wrap around; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import Scratch, text_slices

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a chunk.
CHUNK = 4096
#: States: nothing read, system read, user read, assistant read. Costs to accept from them with no rows left.
END = (0, 4, 2, 0)
_FULL = 15
#: The state that a user or assistant turn leads to where it is due, whatever the row's own role was.
_NEXT = (2, 2, 3, 2)
#: The states that initials u, a, s lead to; -1 where they may not stand.
_READ = ((2, 2, -1, 2), (-1, -1, 3, -1), (1, -1, -1, -1), (-1, -1, -1, -1))
_BY_NEXT = bytes(sum(1 << s for s in range(4) if x >> _NEXT[s] & 1) for x in range(16))
_BY_READ = tuple(bytes(sum(1 << s for s in range(4) if r[s] >= 0 and x >> r[s] & 1) for x in range(16)) for r in _READ)
#: Bits of a row's code beside its initial.
BLANK, TRUNCATED, DUPLICATE = 4, 8, 16


class Layers:
    """Cost layers of a chunk's codes, up to the first that holds all states of ``until`` before the first row.

    ``ahead``: costs of the states behind the last row.
    """

    def __init__(self, codes: bytes, ahead: tuple[int, ...] = END, until: int = 1):
        self.codes, self.base = codes, min(ahead)
        self.found: list[tuple[int, int, bytearray]] = []  # (lowest position, position from which all is full, bitsets between)
        n, full, low, cost = len(codes), len(codes) + 1, len(codes), 0
        while True:
            cells = bytearray()  # from the right
            i = full - 1
            after = _FULL
            while i >= 0:
                if i == n:
                    bits = sum(1 << s for s in range(4) if ahead[s] - self.base <= cost)
                else:
                    code = codes[i]
                    bits = self.at(cost - 3, i + 1) | _BY_NEXT[self.at(cost - 2, i)]
                    if not code & (BLANK | DUPLICATE):
                        cut = code >> 3 & 1
                        bits |= _BY_READ[code & 3][self.at(cost - 1, i + 1) if cut else after]
                        bits |= _BY_NEXT[self.at(cost - 2 - cut, i + 1)]
                if not bits and i < low:
                    break
                cells.append(bits)
                after = bits
                i -= 1
            cells.reverse()
            first = i + 1
            self.found.append((first, full, cells))
            low = min(low, first)
            while full > first and cells[full - 1 - first] == _FULL:
                full -= 1
            if self.at(cost, 0) & until == until:
                break
            cost += 1

    def at(self, cost: int, i: int) -> int:
        """The states before row i from which the rest costs at most ``cost`` above the base."""
        if cost < 0:
            return 0
        if cost >= len(self.found):
            cost = len(self.found) - 1
        first, full, cells = self.found[cost]
        return _FULL if i >= full else cells[i - first] if i >= first else 0

    def cost(self, state: int) -> int:
        """The least cost from before the first row."""
        return self.base + next(c for c in range(len(self.found)) if self.at(c, 0) >> state & 1)

    def trace(self, state: int) -> tuple[str, int]:
        """(the least audit of the cheapest, the state behind the last row)."""
        audit, i, cost = [], 0, self.cost(state) - self.base
        while i < len(self.codes):
            code, due = self.codes[i], _NEXT[state]
            cut, read = code >> 3 & 1, _READ[code & 3][state]
            stays = not code & (BLANK | DUPLICATE)
            if self.at(cost - 3, i + 1) >> state & 1:
                audit.append("D")
                cost, i = cost - 3, i + 1
            elif self.at(cost - 2, i) >> due & 1:
                audit.append("I")
                cost, state = cost - 2, due
            elif stays and read >= 0 and self.at(cost - cut, i + 1) >> read & 1:
                audit.append("K")
                cost, i, state = cost - cut, i + 1, read
            else:
                audit.append("R")
                cost, i, state = cost - 2 - cut, i + 1, due
        return "".join(audit), state


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by a checksum of conversation and turn; nulls are read as one space there."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    found = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return found.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_KEY = ["conv_id", "turn", "role", "head", "h1", "h2"]


def _described(rows: DataFrame) -> DataFrame:
    """The columns of the order, the text, and a code without the bit of duplicates."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    flags = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return rows.select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 24).alias("head"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"),
        (code + flags).cast("int").alias("code"), text.alias("text"),
    )


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """``later``: the row's role and text stand at a smaller turn already; rows of equal turn are left to the stream."""
    same = ["role", "h1", "h2"]
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    sets = rows.where(F.col("code").bitwiseAND(BLANK) == 0).groupBy("conv_id", *same).agg(F.count("*").alias("n"), F.min(turn).alias("first"))
    sets = sets.where("n > 1").select(F.col("conv_id").alias("c"), *(F.col(k).alias(f"s_{k}") for k in same), "first")
    on = F.col("conv_id").eqNullSafe(F.col("c"))
    for k in same:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    found = rows.join(sets, on, "left")
    return found.select(*_KEY, "code", F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """(the key of a chunk's first row, seq, codes, stats); stats stand at a conversation's last chunk: its counts."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in _KEY) + ", seq int, codes binary, stats array<bigint>"

    class Reader:
        def __init__(self, conv):
            self.conv, self.seq, self.codes, self.key = conv, 0, bytearray(), None
            self.last, self.low, self.high, self.turns = None, None, None, 0
            self.blank = self.duplicate = self.truncated = self.illegal = 0

        def read(self, key: tuple, code: int, later: bool) -> None:
            turn = key[1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.last is not None:
                self.illegal += (self.last[1] & 3, code & 3) not in ((2, 0), (0, 1), (1, 0))
                later = later or key == self.last[0]
            self.last = (key, code)
            if code & BLANK:
                self.blank += 1
            elif later:
                self.duplicate += 1
                code = code & ~TRUNCATED | DUPLICATE
            elif code & TRUNCATED:
                self.truncated += 1
            if not self.codes:
                self.key = key
            self.codes.append(code)

        def chunk(self, ended: bool) -> tuple:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            stats = [(gaps + (1 << 63)) % (1 << 64) - (1 << 63), self.blank, self.duplicate, self.truncated, self.illegal] if ended else None
            out = (*self.key, self.seq, bytes(self.codes), stats)
            self.seq, self.codes = self.seq + 1, bytearray()
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kept = None, None
        for batch in batches:
            kept = kept or pa.schema([*(batch.schema.field(i) for i in range(len(_KEY))), ("seq", pa.int32()), ("codes", pa.binary()), ("stats", pa.list_(pa.int64()))])
            out = []
            for *key, code, later in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or reader.conv != key[0]:
                    if reader is not None:
                        out.append(reader.chunk(True))
                    reader = Reader(key[0])
                elif len(reader.codes) == size:
                    out.append(reader.chunk(False))
                reader.read(tuple(key), code, later)
            yield _batch(out, kept)
        if reader is not None:
            yield _batch([reader.chunk(True)], kept)

    dealt = rows.select(*_KEY, "code", "later").repartition("conv_id").sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)


def _planned(chunks: DataFrame) -> DataFrame:
    """Chunks with ``ahead``, the costs of the states behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = END
        for batch in batches:
            out = []
            for codes, seq, ended in zip(batch["codes"].to_pylist(), batch["seq"].to_pylist(), batch["stats"].is_valid().to_pylist()):
                ahead = END if ended else ahead
                out.append(list(ahead))
                if seq:
                    layers = Layers(codes, ahead, _FULL)
                    ahead = tuple(layers.cost(s) for s in range(4))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "ahead"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq")).mapInArrow(run, f"{kinds}, ahead array<bigint>")


class _Repair:
    """One conversation, read through: chunks, and the rows behind them."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.stats = conv, 0, 0, [0] * 5
        self.audits: list[str] = []
        self.waiting: deque[tuple[int, bytes, list[int]]] = deque()
        self.edits: Iterator[str] = iter("")
        self.due, self.left, self.some, self.digest = 0, 0, False, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def filled(self) -> None:
        self.put("user" if _NEXT[self.due] == 2 else "assistant", "")
        self.due = _NEXT[self.due]

    def row(self, role: str, text: str) -> None:
        if not self.left:
            seq, codes, ahead = self.waiting.popleft()
            layers = Layers(codes, tuple(ahead), 1 << self.state)
            if seq == 0:
                self.cost = layers.cost(0)
            audit, self.state = layers.trace(self.state)
            self.audits.append(audit)
            self.edits, self.left = iter(audit), len(codes)
        self.left -= 1
        for edit in self.edits:
            if edit == "I":
                self.filled()
                continue
            if edit == "K":
                self.put(role, text)
                self.due = _READ[{"u": 0, "a": 1, "s": 2}[role[0]]][self.due]
            elif edit == "R":
                self.put("user" if _NEXT[self.due] == 2 else "assistant", text)
                self.due = _NEXT[self.due]
            return

    def result(self) -> tuple:
        while self.due in (1, 2):
            self.filled()
            self.audits.append("I")
        return (self.conv, *self.stats, self.cost, "".join(self.audits), self.digest.hexdigest())


def repair(rows: DataFrame, conversations: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``rows(conv_id, turn, role, text)``.

    ``conversations(conv_id)`` may name further conversations, those without rows.
    """
    scratch = Scratch(rows.sparkSession, "turns")
    whole = _described(rows)
    chunks = scratch.put(_chunks(_with_duplicates(whole.drop("text")), size), "chunks")
    planned = scratch.put(_planned(chunks), "planned")
    scratch.keep("planned")
    columns = [*_KEY, "seq", "text", "codes", "ahead", "stats"]
    names = rows.select("conv_id") if conversations is None else conversations.select("conv_id")
    parts = whole.select(*_KEY, "text").unionByName(planned, allowMissingColumns=True).unionByName(names.distinct(), allowMissingColumns=True)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, None
        for batch in batches:
            kept = kept or pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for part in text_slices(batch, "text", 4 << 20):
                out = []
                for conv, role, seq, text, codes, ahead, stats in zip(*(part[c].to_pylist() for c in ("conv_id", "role", "seq", "text", "codes", "ahead", "stats"))):
                    if current is None or current.conv != conv:
                        if current is not None:
                            out.append(current.result())
                        current = _Repair(conv)
                    if codes is not None:
                        current.waiting.append((seq, codes, ahead))
                        current.stats = stats or current.stats
                    elif text is not None:
                        current.row(role, text)
                yield _batch(out, kept)
        if current is not None:
            yield _batch([current.result()], kept)

    # A chunk stands before its first row: its text is null.
    order = [*_KEY, F.col("text").isNotNull(), "seq"]
    dealt = parts.select(*columns).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string")
