"""N-gram Jaccard join: all links between texts whose shingle sets are similar enough, by R-trees of count vectors.

Two texts link if 100 * |A & B| >= PERCENT * |A | B| for their sets of four-word shingles. Shingles are hashed into groups, and a
set's counts by group are a point. The sum of the minima of two points' coordinates bounds the overlap of their sets, the sum of the
minima of two boxes' upper corners that of all sets inside them; an R-tree of such points, packed by size and then by the widest
coordinate, gives the pairs that may be similar enough. Those are decided on whole sets. Pairs that links already join are passed over,
so a cluster of near copies costs about one check a text.

R-trees are built over texts that can have links at all, which exact counting finds. Texts of one link differ in at most 15/185 of
their joint size, so if a size class's sets are dealt to a few more groups than that, most groups of a link are equal as sets. A text's
tokens are its groups' contents; two linked texts share one among the rarest of each (the prefix filter, by the count of a token in
the whole table). A token of one text only proves nothing, so most texts have no rarest token that another has, and drop out. A passage
that many texts share fills a group alone only where it makes up most of a text, and its tokens are the last to be chosen. Texts
that are connected through chosen tokens form a candidate group, and each is in one group only.

A group of up to ``tile`` shingles is one R-tree. A larger one, however large, is read in two passes of bounded pieces: tiles by a hash,
each an R-tree; and then, where several components are left, the texts outside the largest against the texts of their own and the next
bands of size, in blocks. Components are those of links between distinct word sequences, so copies meet as one.

Edge cases: null, empty and blank texts have an empty set and link with nothing, so each is a component of its own; fewer words than a
shingle are one shingle; repeated rows keep a row each; a null id never names a component, unless the whole class has none; texts of any
length are read whole; an empty table gives an empty result. Only the named columns are read. Shingles, sets of words and tokens are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm import simhash
from quire.llm.common import Scratch, text_slices, texts_of
from quire.llm.components import connected_components

SHINGLE, PERCENT = 4, 85
#: Groups of a count vector; points of a leaf; children of a node above.
GROUPS, LEAF, FAN = 128, 32, 16
#: Shingles of one R-tree.
TILE = 1 << 21
#: Parts of the tokens that are counted one after another, so that only one part's shuffle is on disk.
PARTS = 4
#: Rows of the table of candidates that may be sent to every task.
SENT = 1 << 20
_SEEN = 1 << 20
_U = np.uint64


def similar(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sets of sizes a and b with so many common elements link."""
    return both * (100 + percent) >= percent * (a + b)


def apart(total: int, percent: int = PERCENT) -> int:
    """The most elements in which linked sets of so many elements together differ."""
    return total * (100 - percent) // (100 + percent)


def grams(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order; none for a text without words, one for fewer words than a shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    found = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype=np.uint64, count=n)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(grams(text, shingle))


# Tokens


def classes(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(class, groups of the class, groups that count) for a set of n elements.

    A class holds the sizes of one length in bits. A link is found in the class of its larger set, so a set also has tokens in
    the class above if a link can reach there.
    """
    most, out = n * 100 // percent, []
    for c in range(n.bit_length(), most.bit_length() + 1):
        top = (1 << c) - 1
        widest = apart(2 * top, percent)
        out.append((c, widest + 1 + widest // 3, apart(n + min(most, top), percent) + 1))
    return out


def tokens(found: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(class, slack, tokens) of a sorted set of hashes in each of its classes.

    ``slack``: how many groups that count are more than its groups with elements. Tokens of empty groups are odd and rank behind
    all others; only those are given that count.
    """
    out = []
    for c, groups, need in classes(len(found), percent):
        at = ((found >> _U(32)) * _U(groups)) >> _U(32)
        edge = np.searchsorted(at, np.arange(groups + 1, dtype=np.uint64))
        summed = np.concatenate(([_U(0)], np.cumsum(found * _U(0x9E3779B97F4A7C15) ^ (found >> _U(29)), dtype=np.uint64)))
        held = edge[1:] > edge[:-1]
        name = (np.arange(groups, dtype=np.uint64) << _U(8)) | _U(c)
        key = (summed[edge[1:]] - summed[edge[:-1]]) * _U(0xBF58476D1CE4E5B9) + name * _U(0x94D049BB133111EB)
        key = (key ^ (key >> _U(31))) * _U(0xD6E8FEB86659FD93)
        key = np.where(held, key & ~_U(1), key | _U(1))
        full = int(held.sum())
        out.append((c, need - full, np.concatenate((key[held], key[~held][: max(0, need - full)])).view(np.int64)))
    return out


def word_hash(words: list[bytes]) -> int:
    """A text's node: the hash of its words in order."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def parsed_texts(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, prints: bool = False) -> DataFrame:
    """(doc_id, node, n, fp, slots) of ``docs(doc_id, t)``: the word sequence's hash, its set's size, its fingerprint if asked for (else 0), its tokens.

    A task gives the tokens of equal texts once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slot = pa.struct([("slot", pa.int32()), ("slack", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for part in text_slices(batch, "t", 4 << 20):
                nodes, ns, fps, slots = [], [], [], []
                for text in texts_of(part.column(1)):
                    words = text.lower().split()
                    node = word_hash(words)
                    own = []
                    if not words:
                        n, fp = 0, 0
                    elif node in seen:
                        n, fp = seen[node]
                    else:
                        hashes = grams(text, shingle)
                        found = np.unique(hashes)
                        n, fp = len(found), simhash.fingerprint(hashes) if prints else 0
                        own = [{"slot": c, "slack": s, "keys": k} for c, s, k in tokens(found, percent)]
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen[node] = (n, fp)
                    nodes.append(node)
                    ns.append(n)
                    fps.append(fp)
                    slots.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array(ns, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(slots, pa.list_(slot))],
                    names=["doc_id", "node", "n", "fp", "slots"],
                )

    return docs.select("doc_id", "t").mapInArrow(run, f"doc_id {kind}, node bigint, n bigint, fp bigint, slots array<struct<slot:int,slack:int,keys:array<bigint>>>")


def _chosen(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node): of each text those tokens that count and that another text has too."""
    each = parsed.select("node", F.explode("slots").alias("s")).select("node", "s.slot", "s.slack", F.explode("s.keys").alias("key"))
    met = []
    for i in range(PARTS):
        part = each.where(F.shiftrightunsigned("key", 1).bitwiseAND(PARTS - 1) == i)
        shared = part.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
        shared = scratch.put(shared.select("key", "n"), f"shared{i}")
        met.append(scratch.put(part.join(shared, "key").select("node", "slot", "slack", "n", "key"), f"met{i}"))
        scratch.drop(f"shared{i}")
    met = reduce(DataFrame.union, met)
    listed = met.groupBy("node", "slot", "slack").agg(F.collect_set(F.struct("n", "key")).alias("found"))
    of = lambda odd: F.filter("found", lambda x: x["key"].bitwiseAND(1) == odd)
    listed = listed.select("node", "slack", F.sort_array(of(0)).alias("held"), of(1).alias("empty"))
    take = F.greatest(F.lit(0), F.col("slack") + F.size("held"))
    return listed.select("node", F.explode(F.concat(F.slice("held", 1, take), "empty")).alias("x")).select("x.key", "node").distinct()


def candidates(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, lot): texts that are connected through chosen tokens; a lot is a group of candidates."""
    chosen = scratch.put(_chosen(parsed, scratch), "chosen")
    heads = scratch.put(chosen.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    edges = chosen.join(heads, "key").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    found = scratch.put(connected_components(edges, scratch), "lots")
    for name in ("chosen", "heads", *(f"met{i}" for i in range(PARTS))):
        scratch.drop(name)
    return found.select("node", F.col("root").alias("lot"))


# R-trees


class CountTree:
    """An R-tree of count vectors: for each node the upper corner of its box, and the least and largest set size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent, m = percent, len(sizes)
        order = np.argsort(sizes, kind="stable")
        slabs = []
        for i in range(0, m, LEAF * FAN):
            slab = order[i : i + LEAF * FAN]
            own = counts[slab]
            widest = int((own.max(axis=0) - own.min(axis=0)).argmax())
            slabs.append(slab[np.argsort(own[:, widest], kind="stable")])
        order = np.concatenate(slabs)
        self.leaves = [order[i : i + LEAF] for i in range(0, m, LEAF)]
        high = np.stack([counts[x].max(axis=0) for x in self.leaves])
        low_size, high_size = (np.array([f(sizes[x]) for x in self.leaves]) for f in (np.min, np.max))
        self.levels = [(high, low_size, high_size)]
        while len(high) > 1:
            first = np.arange(0, len(high), FAN)
            high, low_size, high_size = np.maximum.reduceat(high, first), np.minimum.reduceat(low_size, first), np.maximum.reduceat(high_size, first)
            self.levels.append((high, low_size, high_size))

    def near(self, high: np.ndarray, least: int, largest: int) -> np.ndarray:
        """The leaves that may hold a link of a point in the box below ``high`` with a size of ``least`` to ``largest``."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, top = (x[at] for x in self.levels[depth])
            shared = np.minimum(corner, high).sum(axis=1)
            fits = (shared * (100 + self.percent) >= self.percent * (low + least)) & (top * 100 >= self.percent * least) & (largest * 100 >= self.percent * low)
            at = at[fits]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


class Texts:
    """Sets with their points, sizes, names and roots."""

    def __init__(self, nodes: list[int], roots: list[int], sets: list[bytes]):
        self.nodes, self.roots = nodes, roots
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.counts = np.stack([np.bincount((s >> _U(57)).astype(np.int64), minlength=GROUPS) for s in self.sets]).astype(np.int32)


def links(left: Texts, tree: CountTree, right: Texts | None, up: dict[int, int], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that join different roots: among ``left``, or of ``left`` with ``right``. ``up`` holds what has been joined so far."""

    def find(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    other = right or left
    if right is None:
        blocks = list(enumerate(tree.leaves))
    else:
        order = np.argsort(right.sizes, kind="stable")
        blocks = [(-1, order[i : i + LEAF]) for i in range(0, len(order), LEAF)]
    for k, block in blocks:
        counts, sizes = other.counts[block], other.sizes[block]
        for leaf in tree.near(counts.max(axis=0), int(sizes.min()), int(sizes.max())).tolist():
            if leaf < k:
                continue
            mine = tree.leaves[leaf]
            shared = np.minimum(counts[:, None, :], left.counts[mine][None, :, :]).sum(axis=2, dtype=np.int64)
            joint = sizes[:, None] + left.sizes[mine][None, :]
            fits = shared * (100 + percent) >= percent * joint
            if leaf == k:
                fits &= np.triu(np.ones(fits.shape, bool), 1)
            x, y = np.nonzero(fits)
            for i in np.argsort(-(shared[x, y] / joint[x, y]), kind="stable").tolist():
                a, b = int(block[x[i]]), int(mine[y[i]])
                ra, rb = find(other.roots[a]), find(left.roots[b])
                if ra == rb:
                    continue
                both = len(np.intersect1d(other.sets[a], left.sets[b], assume_unique=True))
                if similar(both, len(other.sets[a]), len(left.sets[b]), percent):
                    up[max(ra, rb)] = min(ra, rb)
                    yield other.nodes[a], left.nodes[b]


def pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs, the smaller node first."""
    ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])


def _linked(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(u, v): links between different roots in each unit, the rows of equal ``keys``.

    Side 0 makes the unit's R-tree and, if ``own``, is joined with itself; side 1 streams past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, left, tree, up = None, ([], [], []), None, None, {}

        def ended(own: bool) -> Iterator[tuple[int, int]]:
            nonlocal left, tree, waiting, up
            left, tree, up = None, None, {}
            if waiting[0]:
                left = Texts(*waiting)
                tree = CountTree(left.counts, left.sizes, percent)
                if own:
                    yield from links(left, tree, None, up, percent)
            waiting = ([], [], [])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for part in text_slices(batch, "set", 16 << 20):
                units = list(zip(*(part[k].to_pylist() for k in [*keys, "side"])))
                i = 0
                while i < len(units):
                    j = i + 1
                    while j < len(units) and units[j] == units[i]:
                        j += 1
                    *unit, side = units[i]
                    if unit != current:
                        if waiting[0]:
                            found += ended(True)
                        current, left = unit, None
                    rows_ = [part[c].slice(i, j - i).to_pylist() for c in ("node", "root", "set")]
                    if side == 0:
                        for kept, more in zip(waiting, rows_):
                            kept += more
                    else:
                        if waiting[0]:
                            found += ended(False)
                        if left is not None:
                            found += links(left, tree, Texts(*rows_), up, percent)
                    i = j
            if found:
                yield pair_batch(found)
        if waiting[0]:
            found = list(ended(True))
            if found:
                yield pair_batch(found)

    dealt = rows.select(*keys, "side", "node", "root", "set").repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, lot, set): the sorted shingle hashes of each wanted text of ``docs(t)``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [word_hash(t.lower().split()) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], names=["node", "t"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", 4 << 20):
                found = [shingles(t, shingle).tobytes() for t in texts_of(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["node", "lot", "set"])

    few = wanted.count() <= SENT
    named = docs.select("t").where("t is not null").mapInArrow(name, "node bigint, t string")
    texts = named.join(F.broadcast(wanted) if few else wanted, "node").select("node", "lot", "t").dropDuplicates(["node"])
    return texts.mapInArrow(read, "node bigint, lot bigint, set binary")


def _across(sets: DataFrame, roots: DataFrame, large: DataFrame, tile: int, percent: int) -> DataFrame:
    """Rows of the second pass: texts outside a large lot's largest component, and all that are near enough to them in size."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9)).cast("int")
    n = F.octet_length("set") / 8
    rooted = sets.join(large.select("lot"), "lot", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.withColumn("n", n).withColumn("band", band)
    parts = rooted.groupBy("lot", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("lot").agg(F.max(F.struct("m", "root")).alias("main"), F.count("*").alias("c")).where("c > 1").select("lot", F.col("main.root").alias("main"))
    outer = rooted.join(main, "lot").where("root <> main")
    blocks = outer.groupBy("lot", "band").agg(F.ceil(F.sum("n") / tile).cast("int").alias("blocks"))
    left = outer.join(blocks, ["lot", "band"]).select("lot", "band", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "root", "set")
    reach = rooted.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    whole = reach.groupBy("lot", "band").agg(F.ceil(F.sum("n") / (8 * tile)).cast("int").alias("parts"))
    sizes = blocks.join(whole, ["lot", "band"])
    right = reach.join(sizes, ["lot", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("lot", "band", "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "node", "root", "set")
    left = left.join(sizes.select("lot", "band", "parts"), ["lot", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.select("lot", "band", "block", "part", F.lit(0).alias("side"), "node", "root", "set").union(right)


def joined(sets: DataFrame, scratch: Scratch, percent: int = PERCENT, tile: int = TILE, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of all of ``sets(node, lot, set)`` that have links; ``known(u, v)`` are links that have been found before."""
    sizes = scratch.put(sets.groupBy("lot").agg(F.ceil(F.sum(F.octet_length("set") / 8) / tile).cast("int").alias("tiles"), F.count("*").alias("m")), "sizes")
    rooted = sets.withColumn("root", F.col("node"))
    if known is not None:
        before = connected_components(known, scratch).withColumnRenamed("root", "r")
        rooted = sets.join(scratch.put(before, "before"), "node", "left").select("node", "lot", "set", F.coalesce("r", "node").alias("root"))
    tiled = rooted.join(sizes, "lot").select("lot", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), F.lit(0).alias("side"), "node", "root", "set")
    first = _linked(tiled, ["lot", "tile"], percent)
    first = scratch.put(first if known is None else first.union(known), "first")
    roots = scratch.put(connected_components(first, scratch), "roots")
    large = sizes.where("tiles > 1")
    if large.isEmpty():
        return roots
    second = _linked(_across(sets, roots, large, tile, percent), ["lot", "band", "block", "part"], percent)
    second = scratch.put(second.where("u <> v").distinct(), "second")
    return scratch.put(connected_components(first.union(second), scratch), "joined")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; the component is its smallest reachable doc_id."""
    scratch = Scratch(docs.sparkSession, "ngramjoin")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    parsed = scratch.put(parsed_texts(narrow, percent), "parsed")
    rows = scratch.put(parsed.select("doc_id", "node", "n"), "rows")
    lots = candidates(parsed, scratch)
    scratch.drop("parsed")
    sets = scratch.put(sets_of(narrow, lots), "sets")
    roots = joined(sets, scratch, percent, tile)
    first = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.put(named.join(least, "root").select("node", "component_id"), "named")
    scratch.keep("rows", "named")
    full = rows.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
