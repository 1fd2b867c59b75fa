import random
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import packing


def test_best_fit_and_conflicts():
    packer = packing.Packer(10)
    assert packer.add(6, "a", 1) == (0, 0) and packer.add(7, "b", 2) == (1, 0)
    assert packer.add(3, "c", 3) == (1, 7)
    assert packer.add(4, "a", 4) == (2, 0)  # source a is in bin 0 already
    assert packer.add(4, "d", 1) == (2, 4)  # cluster 1 is in bin 0
    assert packer.add(2, None, None) == (2, 8) and packer.add(4, None, None) == (0, 6)


def test_tightest_bin_against_plain_search():
    rng = random.Random(5)
    packer, bins = packing.Packer(50), []
    for size in sorted((rng.randint(1, 50) for _ in range(400)), reverse=True):
        source, cluster = rng.choice("abcdefff"), rng.randint(0, 60)
        got, offset = packer.add(size, source, cluster)
        fits = [50 - b[0] for b in bins if b[0] + size <= 50 and source not in b[1] and cluster not in b[2]]
        if got == len(bins):
            assert not fits
            bins.append([0, set(), set()])
        else:
            assert 50 - bins[got][0] == min(fits)
        assert offset == bins[got][0]
        bins[got][0] += size
        bins[got][1].add(source)
        bins[got][2].add(cluster)


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 300), rng.choice(["hot", "hot", "x", "y", None])) for i in range(300)]
    rows += [(900, "word " * 900, "x"), (901, None, "x"), (902, "", None), (4, rows[4][1], rows[4][2]), (None, "abc", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("piece", F.lit(1))
    got = packing.pack(df, F.xxhash64("text"), capacity=600, group_rows=100).collect()
    bins, parts = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["start_byte"], r["piece_bytes"]))
        if r["piece_bytes"]:
            bins[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None
    for b in bins.values():
        spots = sorted((r["bin_offset"], r["piece_bytes"]) for r in b)
        assert all(a + n == c for (a, n), (c, _) in zip(spots, spots[1:])) and spots[0][0] == 0 and sum(spots[-1]) <= 600
        sources = [r["source"] for r in b if r["source"] is not None]
        assert len(sources) == len(set(sources))
    for i, t, _ in rows:
        if i not in (4,):
            own = sorted(parts[i])
            assert sum(n for _, n in own) == len((t or "").encode())
            raw = (t or "").encode()
            assert b"".join(raw[a : a + n].decode().encode() for a, n in own) == raw
    assert len(parts[4]) == 2 and packing.pack(df.where("doc_id < 0"), F.lit(1), capacity=600).count() == 0


def test_open_bins_of_all_groups_meet(spark):
    rows = [(i, "x" * 290, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = lambda group_rows: packing.pack(df, F.col("doc_id"), 600, group_rows=group_rows).select("bin_id").distinct().count()
    assert bins(1000) == 100 and bins(7) == 100  # groups with an odd number of pieces leave a half-filled bin each


def test_long_text_and_clashing_columns(spark):
    long = "ab é" * 60000
    df = spark.createDataFrame([(1, long, "s", 3, "x"), (1, long, "s", 3, "x")], "doc_id long, text string, source string, bin_id long, used string")
    got = packing.pack(df, F.xxhash64("text"), capacity=1000).collect()
    assert sum(r["piece_bytes"] for r in got) == 2 * len(long.encode()) and max(r["piece_bytes"] for r in got) <= 1000
