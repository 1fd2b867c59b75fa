"""Sharding by a minimax contiguous partition of ordered, atomic groups.

Rows of equal text form a group that no shard may split. Groups are ordered by a hash of their text
and cut into contiguous shards so that the largest shard is as small as can be: a binary search
finds the smallest capacity that a greedy fill turns into few enough shards. Under that capacity the cuts go,
between the greedy fills from the front and from the back, to the known totals nearest to equal shares of what is
left, so that the last shards aren't left short. Only DataFrame operations run on the rows.

The search needs the running totals at the ends of groups, of which there are as many as groups.
The driver never sees them all: it works on cells of bounded number (``CELLS`` a shard), each known
by its least and greatest running total. A greedy fill that rounds down to known totals proves a
capacity feasible; one that rounds up proves it infeasible. Between the two remain a few cells
around each cut, which the next pass reads at 64 times the resolution, until both answers agree;
the capacity is then exact.

Groups larger than an equal share of what is left are put first, each in a shard of its own: they
set the capacity anyway, and without that one of them would let the greedy fill leave shards empty.

Sizes: UTF-8 bytes of the text plus ``overhead``. Edge cases: null and empty texts are one group of
rows with the overhead as size; repeated rows get slots of their own; fewer groups than shards
leave the last shards empty; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import Scratch

CELLS = 4096
FINER = 64


class _Cells:
    """Known running totals: per cell the least and the greatest."""

    def __init__(self, rows: list[tuple[int, int]], total: int):
        self.low = [r[0] for r in rows]
        self.high = [r[1] for r in rows]
        self.total = total

    def floor(self, t: int) -> tuple[int, int]:
        """(a known total at most t, an upper bound of the greatest total at most t)."""
        if t >= self.total:
            return self.total, self.total
        i = bisect_right(self.low, t) - 1
        if i < 0:
            return 0, 0
        if t >= self.high[i]:
            return self.high[i], self.high[i]
        return self.low[i], t

    def fill(self, capacity: int, shards: int, upper: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = max(at, self.floor(at + capacity)[upper])
            cuts.append(at)
            if at >= self.total:
                break
        return cuts

    def least(self, shards: int, start: int, upper: bool) -> int:
        """The least capacity from ``start`` whose fill reaches the end."""
        low, high = start, self.total
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, upper)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts between the greedy fills from the front and from the back, each near an equal share of what is left."""
        ends = sorted({0, self.total, *self.low, *self.high})
        latest = self.fill(capacity, shards, upper=False)
        # From the back: the earliest known total from which the remaining shards can still take the rest.
        need = self.total
        earliest = [need]
        for _ in range(shards - 1):
            need = ends[bisect_left(ends, need - capacity)] if need > capacity else 0
            earliest.append(need)
        cuts, at = [], 0
        for i in range(shards):
            left = shards - i
            low = max(earliest[left - 1], at)
            high = min(latest[min(i, len(latest) - 1)], ends[bisect_right(ends, at + capacity) - 1])
            target = at + (self.total - at) / left
            j = bisect_left(ends, target)
            near = min((e for e in ends[max(0, j - 1) : j + 1]), key=lambda e: (abs(e - target), e))
            at = max(low, min(high, near))
            cuts.append(at)
        return cuts


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> list[int]:
    """The running totals after which to cut ``ends(s)``, the totals at the ends of the groups."""
    if total == 0 or shards < 1:
        return []
    unit = max(1, total // (shards * CELLS))
    zones = [(0, total)]
    known: list[tuple[int, int]] = []
    while True:
        inside = F.lit(False)
        for a, b in zones:
            inside = inside | F.col("s").between(a, b)
        # Zones hold at most a bounded number of cells of this unit.
        cells = ends.where(inside).groupBy(F.floor(F.col("s") / F.lit(unit)).alias("cell")).agg(F.min("s").alias("a"), F.max("s").alias("b"))
        fresh = sorted((r["a"], r["b"]) for r in cells.collect())
        # Cells from a coarser pass stay where no zone covers them whole.
        outside = [k for k in known if not any(a <= k[0] and k[1] <= b for a, b in zones)]
        known = sorted({*outside, *fresh})
        model = _Cells(known, total)
        first = -(-total // shards)
        best = model.least(shards, first, upper=False)
        bound = model.least(shards, first, upper=True)
        if best == bound or unit == 1:
            return model.balanced(best, shards)
        low, high = model.fill(bound, shards, upper=False), model.fill(best, shards, upper=True)
        zones = []
        for i, b in enumerate(high):
            a = low[i] if i < len(low) else total
            i, j = bisect_left(model.high, min(a, b)), bisect_right(model.low, max(a, b)) - 1
            i, j = min(i, len(known) - 1), min(max(j, 0), len(known) - 1)
            zones.append((known[min(i, j)][0], known[max(i, j)][1]))
        unit = max(1, unit // FINER)


def _offsets(spark, df: DataFrame, value: str) -> DataFrame:
    """(part, o, r): the sum of ``value`` and the number of rows before each partition: a row each."""
    sums = df.groupBy("part").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("o"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("r"))


def assign(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )
    rows = scratch.put(rows, "rows")
    heavy = _heavy(rows, shards)
    rank = F.lit(len(heavy))
    for i, (g, _, _) in reversed(list(enumerate(heavy))):
        rank = F.when(F.col("g") == F.lit(bytes(g)), F.lit(i)).otherwise(rank)
    # A global order whose partitions a hot group can span: the id is part of the key.
    ordered = rows.withColumn("first", rank).orderBy("first", "g", "doc_id", "size").withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.put(ordered.withColumn("part", F.shiftright("at", 33)), "ordered")
    scratch.drop("rows")
    within = Window.partitionBy("part").orderBy("at")
    running = ordered.join(F.broadcast(_offsets(spark, ordered, "size")), "part")  # a row a partition
    running = running.select(
        "doc_id", "size", "text_crc32", "g", "first",
        (F.col("o") + F.sum("size").over(within)).alias("end"),
        (F.col("r") + F.row_number().over(within) - 1).alias("nth"),
    )
    running = scratch.put(running, "running")
    scratch.drop("ordered")
    light = running.where(F.col("first") == len(heavy))
    ends = scratch.put(light.groupBy("g").agg(F.max("end").alias("s")).select(F.col("s") - sum(s for _, s, _ in heavy)), "ends").toDF("s")
    total = ends.agg(F.max("s")).first()[0] or 0
    cuts = minimax_cuts(ends, total, shards - len(heavy))
    scratch.keep("running")
    base = sum(s for _, s, _ in heavy)
    bounds, at = [], 0
    for _, s, _ in heavy:
        at += s
        bounds.append(at)
    bounds += [base + c for c in cuts]
    begin = F.col("end") - F.col("size")
    # At most one bound a shard; a row's shard is the number of bounds up to its begin.
    shard = F.aggregate(
        F.array(*(F.lit(b).cast("long") for b in bounds[:-1])) if len(bounds) > 1 else F.array().cast("array<bigint>"),
        F.lit(0),
        lambda acc, b: acc + F.when(b <= begin, 1).otherwise(0),
    )
    placed = running.select("doc_id", "size", "text_crc32", shard.alias("shard"), "nth")
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))
    placed = placed.join(F.broadcast(starts), "shard")  # a row a shard
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("start")).cast("long").alias("slot"))


def _heavy(rows: DataFrame, shards: int) -> list[tuple[bytes, int, int]]:
    """(group, size, rows) of the groups over an equal share, largest first."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    left = rows.agg(F.sum("size")).first()[0] or 0
    largest = groups.orderBy(F.desc("s"), "g").limit(shards).collect()  # a row a shard at most
    out: list[tuple[bytes, int, int]] = []
    for r in largest:
        if len(out) == shards - 1 or r["s"] * (shards - len(out)) <= left:
            break
        out.append((bytes(r["g"]), r["s"], r["n"]))
        left -= r["s"]
    return out
