import numpy as np
from pyspark.sql import functions as F

from quire.llm import ann


def rows(n=600, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[100:160] = x[100]
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def test_recall_scores_and_ties(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for chunk_bytes in (16 << 20, 12 * 24 * 40):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, chunk_bytes=chunk_bytes).collect()
        queries = [i for i in range(600) if i % 20 == 0]
        truth = ann.brute_force(df, queries)
        found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in queries}
        assert sum(len(set(found[q]) & set(truth[q])) for q in queries) >= 0.9 * 5 * len(queries)
        assert found[100] == [101, 102, 103, 104, 105]
        by = dict(data)
        for r in got:
            a, b = np.array(by[r["query_id"]]), np.array(by[r["vec_id"]])
            assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_edges(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (50, [0.0, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, list int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(df.where("vec_id = 99"), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_at_three_sizes(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 32))
    shares = []
    for n in (300, 1500, 6000):
        x = centres[rng.integers(0, 40, n)] + 0.7 * rng.standard_normal((n, 32))
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        queries = list(range(0, n, 50))
        truth = ann.brute_force(df, queries)
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        shares.append(sum(len(got[q] & set(truth[q])) for q in queries) / (5 * len(queries)))
    assert min(shares) >= 0.9, shares


def test_equal_vectors_answer_with_the_smallest_ids(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(20)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 400, 50):
        assert [v for _, v in sorted(got[q])] == [i for i in range(6) if i != q][:5]
