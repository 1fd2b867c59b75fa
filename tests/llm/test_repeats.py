import random

import numpy as np
import pytest

from quire.llm import repeats
from quire.llm.runindex import RunIndex, long_matches

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    """Per text the set of removed byte positions."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i].update(range(p, p + length))
    return out


def corpus(seed, n=60, alphabet="abcd é"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    common = [word(k) for k in (30, 45, 60, 90, 150)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(common) if rng.random() < 0.5 else word(rng.randint(0, 80)))
        texts.append("".join(parts))
    texts += [texts[3], texts[3], None, "", "a" * 300, "ab" * 120 + "x", "a" * 130]
    near = word(400)
    for _ in range(12):
        k = rng.randrange(400)
        texts.append(near[:k] + word(3) + near[k + 3 :])
    return texts


@pytest.mark.parametrize("group_rows", [1000, 2])
def test_against_brute_force(spark, group_rows):
    texts, length = corpus(group_rows), 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, length=length, group_rows=group_rows).collect()}
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), text, gone in zip(rows, raw, brute(raw, length)):
        found = {p for s in got[i]["spans"] for p in range(s["start"], s["end"])}
        assert found == gone, i
        assert got[i]["n_bytes"] == len(text) and got[i]["n_removed"] == len(gone)
        assert bytes(got[i]["kept"]) == bytes(b for p, b in enumerate(text) if p not in gone)


def test_repeated_rows_and_kept_columns(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text[:150], "y")], "doc_id long, text string, h string")
    got = repeats.remove_repeats(df, keep=("h",), length=200).orderBy("doc_id").collect()
    assert [(r["h"], r["n_removed"]) for r in got] == [("x", 500), ("x", 500), ("y", 0)]
    none = repeats.remove_repeats(df.where("doc_id > 5"))
    assert none.count() == 0


def test_text_over_a_sort_keys_place(spark):
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 5 << 20, dtype=np.uint8).tobytes().decode()
    passage = long[(4 << 20) + 70 : (4 << 20) + 370]
    df = spark.createDataFrame([(1, long), (2, "A" + passage + "B"), (3, long[:199])], SCHEMA)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.remove_repeats(df).select("doc_id", "spans").collect()}
    assert got == {1: [((4 << 20) + 70, (4 << 20) + 370)], 2: [(1, 301)], 3: []}


def test_index_groups_follow_the_length(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = word(380)
    texts = [word(500) + core + word(500) for _ in range(1400)] + [word(300)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = repeats.remove_repeats(df, length=400).where("n_removed > 0").count()
    assert got == sum(1 for i in set().union(*(x for x in _shared(texts, 400))))


def _shared(texts, length):
    """Texts that hold a window that stands elsewhere too."""
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(hash(t[p : p + length]), []).append(i)
    return (set(x) for x in where.values() if len(x) > 1)


def test_index_statistics():
    rng = random.Random(5)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 9))]
        strings += strings[:2]
        groups = np.array([rng.randint(0, 2) for _ in strings])
        index = RunIndex(strings, groups)
        got = index.statistics()
        for i, s in enumerate(strings):
            for p in range(len(s)):
                best = 0
                for j, t in enumerate(strings):
                    if groups[i] == groups[j]:
                        for q in range(len(t)):
                            if (i, p) != (j, q):
                                k = 0
                                while p + k < len(s) and q + k < len(t) and s[p + k] == t[q + k]:
                                    k += 1
                                best = max(best, k)
                assert got[index.starts[i] + p] == best
        assert index.runs <= index.n


def test_repetitive_collection_has_few_runs():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    strings = [base[:i] + b"x" + base[i + 1 :] for i in range(0, 400, 4)]
    index = RunIndex(strings, np.zeros(len(strings), int))
    assert index.runs * 20 < index.n
    assert {i for i, *_ in long_matches(strings, np.zeros(len(strings), int), 100)} == set(range(len(strings)))


@pytest.mark.parametrize("copies, group_rows", [(6, 4), (10000, 2500)])
def test_more_equal_rows_than_a_group(spark, copies, group_rows):
    """Rows with one id (or none) and one text, next to documents that share a passage with them."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = word(230)
    rows = [(None, word(60) + passage + word(40))] * copies + [(7, word(90) + passage)] * copies + [(1, passage + word(10)), (2, word(300) + passage)]
    few = [*dict.fromkeys(rows)] + [rows[0], (7, rows[copies][1])]  # two of each are as good as all
    gone = brute([t.encode() for _, t in few], 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = repeats.remove_repeats(df, group_rows=group_rows).groupBy("doc_id", "n_removed").count().collect()
    want = {d: len(g) for (d, _), g in zip(few, gone)}
    assert want[1] >= 230 and want[2] >= 230 and want[None] == 330
    assert {r["doc_id"]: (r["n_removed"], r["count"]) for r in got} == {d: (n, copies if d in (None, 7) else 1) for d, n in want.items()}


def test_hash_of_texts_agrees(spark):
    for t in ("", "a", "é" * 40, "x" * 1000):
        df = spark.createDataFrame([(t,)], "text string")
        assert df.select(repeats.text_hash("text")).first()[0] % (1 << 64) == repeats.xxhash.xxh64_intdigest(t.encode(), 42)
