"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are normalised and rotated by a fixed random orthogonal matrix, so that a few leading
dimensions already say much about a distance. Lists come from k-means on a bounded sample
(``sample_rows`` vectors); their number follows the square root of the rows up to ``max_lists``. Every row goes to its
nearest list and every query to the lists nearest to it. How many those are is measured: the true neighbours of ``sample_queries``
queries are found in one pass over all rows, and the least number of lists that holds the share ``recall`` of them is
probed. It is high on vectors without any cluster structure, and falls as the rows grow closer.

A list is read in chunks of bounded bytes, so a list with any share of the rows is many tasks. A query
first reads its nearest lists whole; its k-th distance there bounds the scan of all others. In these the columns are read
block by block: after each block a candidate's partial distance, scaled to all dimensions, is tested against that bound, and
the candidate is abandoned if it lies beyond by more than sampling error allows (``eps`` standard errors, less as more
of the dimensions are seen). Survivors are scored on the original vectors in double precision.

Of equal vectors only the k + 1 smallest ids can be among the answers; the others are queries but no candidates.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; ties go to the smaller id; a query is
never its own candidate (rows with its id are left out); fewer than k candidates give fewer rows;
null ids take no part. Repeated rows count once. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import Scratch


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows give equal values."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ centres.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


@dataclass
class Lists:
    """The index: a rotation and the centres of the lists. Its size is bounded by ``max_lists``."""

    dim: int
    turn: np.ndarray
    centres: np.ndarray

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))) @ self.turn


def scan(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, block: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that survive; ``bound``: a squared distance for each query that matches have to stay under."""
    dim = rows.shape[1]

    def limit(seen: int) -> np.ndarray:
        return (bound * (1 + eps * np.sqrt((1 - seen / dim) / seen)) ** 2 + 1e-5) * (seen / dim)

    seen = min(block, dim)
    q, x = queries[:, :seen], rows[:, :seen]
    partial = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    at, to = np.nonzero(partial <= limit(seen)[:, None])
    partial = partial[at, to]
    while seen < dim and len(at):
        upto = min(seen + block, dim)
        diff = rows[to, seen:upto] - queries[at, seen:upto]
        partial = partial + np.einsum("ij,ij->i", diff, diff)
        seen = upto
        keep = partial <= limit(seen)[at]
        at, to, partial = at[keep], to[keep], partial[keep]
    return at, to


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, once each, with vectors as arrays of doubles."""
    v = F.col(vec_col).cast("array<double>")
    # ANSI comparisons with NaN: x - x is zero exactly for finite x.
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (~F.isnan(x)) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine & some).dropDuplicates(["vec_id", "v"])


def fit(vectors: DataFrame, dim: int, rows: int, sample_rows: int = 16384, max_lists: int = 1024, seed: int = 7) -> Lists:
    """Centres from the ``sample_rows`` vectors whose ids have the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    x = np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, dim)
    model = Lists(dim, rotation(dim, seed), np.zeros((0, dim)))
    x = model.rotated(x)
    if len(x):
        model.centres = kmeans(x, max(1, min(max_lists, int(np.sqrt(rows)), -(-len(x) // 8))), seed=seed)
    return model


def _probes(placed: DataFrame, queries: DataFrame, model: Lists, k: int, recall: float, sample_queries: int) -> int:
    """The least number of lists that holds the share ``recall`` of the true neighbours of a bounded sample of queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_queries).collect()
    if not some:
        return 1
    names = np.array([r["vec_id"] for r in some], dtype=object)
    whole = np.array([r["v"] for r in some])
    unit = (whole / np.sqrt((whole * whole).sum(axis=1, keepdims=True))).T
    kind = placed.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), len(unit))
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            if not len(rows):
                continue
            score = (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))) @ unit
            score[ids[:, None] == names[None, :]] = -2
            near = np.argsort(-score, axis=0, kind="stable")[:k]
            q = np.broadcast_to(np.arange(len(names)), near.shape).ravel()
            at = near.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(score[at, q])], names=["q", "vec_id", "list", "score"]
            )

    best = placed.select("vec_id", "v", "list").mapInArrow(run, f"q bigint, vec_id {kind}, list int, score double").where("score > -2")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "list").collect()  # k rows a sampled query
    place = np.argsort(np.argsort(-(model.rotated(whole) @ model.centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort([place[r["q"], r["list"]] for r in true])
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1 if len(ranks) else 1


def nearest(
    df: DataFrame,
    query_where,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    recall: float = 0.97,
    block: int = 8,
    eps: float = 2.5,
    chunk_bytes: int = 16 << 20,
    sample_rows: int = 16384,
    max_lists: int = 1024,
    sample_queries: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``query_where`` (a Column over
    ``vec_id``) its k nearest other rows by cosine.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    vectors = scratch.put(_vectors(df, id_col, vec_col), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    kind = df.schema[id_col].dataType.simpleString()
    if not lengths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim, n_rows = lengths[0]["d"], lengths[0]["n"]
    vectors = vectors.where(F.size("v") == dim)
    lists = fit(vectors, dim, n_rows, sample_rows, max_lists)
    model = spark.sparkContext.broadcast(lists)  # max_lists centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), dim)
            near = (model.value.rotated(rows) @ model.value.centres.T).argmax(axis=1) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["vec_id", "v", "list"])

    queries = vectors.where(query_where).select("vec_id", "v")
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    placed = scratch.put(first.mapInArrow(assign, f"vec_id {kind}, v array<double>, list int"), "placed")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    count = np.array([sizes.get(i, 0) for i in range(len(lists.centres))])
    probes = _probes(placed, queries, lists, k, recall, sample_queries)
    chunks = np.maximum(1, -(-count * dim * 12 // chunk_bytes))
    per_list = F.element_at(F.array(*(F.lit(int(c)) for c in chunks)), F.col("list") + 1)
    base = placed.select("list", F.pmod(F.xxhash64("vec_id"), per_list).cast("int").alias("chunk"), "vec_id", "v", F.lit(0.0).alias("bound"), F.lit(False).alias("q"))

    def router(near: bool):
        """Sends each query to all chunks of its nearest lists, with enough rows for a bound, or of the others that it probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column(1), dim)
                if not len(rows):
                    continue
                order = np.argsort(-(model.value.rotated(rows) @ model.value.centres.T), axis=1, kind="stable")
                enough = np.cumsum(count[order], axis=1) >= 4 * k + 1
                own = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(count))
                at, to, parts = [], [], []
                for i, m in enumerate(own.tolist()):
                    for j in (order[i, :m] if near else order[i, m:probes]).tolist():
                        if count[j]:
                            n = int(chunks[j])
                            at += [i] * n
                            to += [j] * n
                            parts += range(n)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(parts, pa.int32()), *(batch.column(c).take(take) for c in range(3)), pa.array([True] * len(at))],
                    names=["list", "chunk", "vec_id", "v", "bound", "q"],
                )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1).astype(np.int64)
            is_query = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            if not len(keys):
                continue
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(keys)]):
                key, ids, rows = tuple(keys[a]), batch.column(2).slice(a, b - a), _matrix(batch.column(3).slice(a, b - a), dim)
                if key != current:
                    current, held, ready = key, [], None
                if not is_query[a]:
                    held.append((ids, rows))
                    continue
                if not held:
                    continue
                if ready is None:
                    whole = np.concatenate([r for _, r in held])
                    names = pa.concat_arrays([i for i, _ in held])
                    ready = (names, np.array(names.to_pylist(), dtype=object), whole, model.value.rotated(whole).astype(np.float32))
                bound = batch.column(4).slice(a, b - a).to_numpy(zero_copy_only=False)
                yield from _found(ids, rows, bound, ready, model.value, k, block, eps)

    def searched(asked: DataFrame, near: bool) -> DataFrame:
        routed = asked.select("vec_id", "v", "bound").mapInArrow(router(near), f"list int, chunk int, vec_id {kind}, v array<double>, bound double, q boolean")
        both = base.union(routed).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "q", "vec_id")
        return both.mapInArrow(search, f"query_id {kind}, vec_id {kind}, score double")

    close = scratch.put(searched(queries.withColumn("bound", F.lit(float("inf"))), near=True).distinct(), "close")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = close.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", (2 - 2 * F.col("score")).alias("bound"))
    asked = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = close.union(searched(asked, near=False)).distinct()
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Pairs of a query and a row that are held at once.
PAIRS = 1 << 17


def _found(ids: pa.Array, rows: np.ndarray, bound: np.ndarray, ready, model: Lists, k: int, block: int, eps: float) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of each query's k best survivors among a chunk's rows."""
    names, own, whole, chunk = ready
    turned = model.rotated(rows).astype(np.float32)
    asked = np.array(ids.to_pylist(), dtype=object)
    step = max(1, PAIRS // len(own))
    for i in range(0, len(asked), step):
        at, to = scan(turned[i : i + step], chunk, bound[i : i + step].astype(np.float32), block, eps)
        other = own[to] != asked[i : i + step][at]
        at, to = at[other] + i, to[other]
        score = np.concatenate([_cosines(rows[at[j : j + PAIRS]], whole[to[j : j + PAIRS]]) for j in range(0, len(at), PAIRS)]) if len(at) else np.zeros(0)
        order = np.lexsort((own[to].astype(str) if own.dtype == object and len(own) and isinstance(own[0], str) else own[to].astype(np.int64), -score, at))
        at, to, score = at[order], to[order], score[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1)) if len(at) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        best = nth < k
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at[best])), names.take(pa.array(to[best])), pa.array(score[best])], names=["query_id", "vec_id", "score"]
        )


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in double precision; equal rows give equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def brute_force(df: DataFrame, query_ids: list[int], id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> dict[int, list[int]]:
    """The true neighbours of a few queries, read through the driver; for measuring recall in tests."""
    rows = [(r[0], r[1]) for r in df.select(id_col, vec_col).collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = [i for i, _ in rows]
    at = {i: n for n, i in enumerate(ids)}
    out = {}
    for q in query_ids:
        score = exact_cosine(x[at[q]], x)
        out[q] = [i for _, i in sorted((-s, i) for s, i in zip(score.tolist(), ids) if i != q)[:k]]
    return out
