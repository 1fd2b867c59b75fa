import random
import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from quire.llm import sharding
from quire.llm.common import shared_dir


def least_capacity(sizes, shards):
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("cells", [4096, 2])
def test_minimax_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    monkeypatch.setattr(sharding, "FINER", 64 if cells > 2 else 3)
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcé") for _ in range(rng.randint(0, 400)))) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)] + [(None, None), (None, ""), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.assign(df, 8).collect()
    assert len(got) == len(rows)
    size, shards, order = defaultdict(int), defaultdict(set), {}
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 16
    for t in size:
        order[zlib.crc32(t.encode())] = md5(t.encode()).digest()
    fill, slots = defaultdict(int), defaultdict(list)
    for r in got:
        fill[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(fill) == set(range(8))
    ordered = [size[t] for t in sorted(size, key=lambda t: md5(t.encode()).digest())]
    assert max(fill.values()) == least_capacity(ordered, 8)
    assert shared_dir(spark)


def test_hot_group_gets_its_own_shard(spark):
    rows = [(i, "same text" * 20) for i in range(300)] + [(1000 + i, f"text {i}" * (i % 9)) for i in range(500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    fill = {r["shard"]: (r["n"], r["b"]) for r in got.groupBy("shard").agg({"size": "sum", "doc_id": "count"}).toDF("shard", "b", "n").collect()}
    assert fill[0][0] == 300 and set(fill) == set(range(10))
    rest = [b for s, (_, b) in fill.items() if s]
    assert max(rest) - min(rest) < 1600


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = sharding.assign(df, 5).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert sharding.assign(df.where("doc_id > 9"), 5).count() == 0
