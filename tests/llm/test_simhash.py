import random
from itertools import combinations

import xxhash

from quire.llm import simhash

SCHEMA = "doc_id long, text string"


def plain(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, most=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 30, 200]))) for _ in range(80)]
    long = " ".join(rng.choice(vocab) for _ in range(3000))
    for i in range(25):
        words = long.split()
        words[rng.randrange(3000)] = "changed"
        out.append(" ".join(words))
    return [*out, out[0], out[0].upper(), None, "", " \t\n", "One", "one\x0btwo"]


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, texts()[0]), (5, texts()[5])]
    fps = [plain(t) for _, t in rows]
    want = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, components([i for i, _ in rows], fps))), key=str)
    df = spark.createDataFrame(rows, SCHEMA)
    for dense in (256, 1):
        got = simhash.near_duplicates(df, dense=dense).collect()
        assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=str) == want
    assert len({c for *_, c in want}) < len(rows) - 20


def test_links_and_chains(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set()
    for b in base:
        for _ in range(12):
            fps.add(b)
            b ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {tuple(sorted(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) % (1 << 64)).bit_count() <= 2}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {tuple(sorted(r)) for r in simhash.links(df).collect()} == want


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 9, "x")], "doc_id long, text string, fp int, component_id string")
    assert simhash.near_duplicates(df).collect()[0]["component_id"] == 1
    assert simhash.near_duplicates(df.where("doc_id = 7")).count() == 0
