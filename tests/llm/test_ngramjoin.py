"""The n-gram Jaccard join against all pairs: thresholds met exactly, clusters, templates, small tiles, odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from quire.llm import ngramjoin, queries

SCHEMA = "doc_id long, text string, node long, lot string"


def grams(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain(rows):
    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: rng.choices(vocab, k=n)
    out = [" ".join(prose(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 30, 100]))) for _ in range(120)]
    for n in (9, 23, 40, 103, 200, 260):  # copies on both sides of the threshold
        base = prose(n)
        out.append(" ".join(base))
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 28))):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1, 1])] = prose(rng.choice([0, 1, 1]))
            out.append(" ".join(words))
    chain = prose(150)
    for _ in range(30):
        chain[rng.randrange(150)] = rng.choice(vocab)
        out.append(" ".join(chain))
    shared = prose(60)
    out += [" ".join(shared + prose(60)) for _ in range(60)]  # half in common: no links
    lines = [prose(12) for _ in range(12)]
    out += [" ".join(sum(rng.sample(lines, 9), [])) for _ in range(60)]  # made of common lines only
    for k in range(15, 24):  # sets at exactly the threshold: 20 of 20 + k elements and the like
        base = prose(200)
        out += [" ".join(base), " ".join(base[: 200 - k] + prose(k))]
    return out


def table():
    found = texts()
    rows = list(enumerate(found)) + [(None, found[3]), (3, found[140]), (1000, found[7].upper()), (1001, found[7]), (1001, found[7])]
    rows += [(1002, None), (1003, ""), (1004, " \t\n\x0b"), (1005, None), (1006, "One"), (1007, "one\x0c"), (1008, "one\x1fone"), (None, "alone here now then"), (1009, "x " * 50000)]
    return [(*r, 1, "x") for r in rows]


@pytest.fixture(scope="module")
def want():
    return plain(table())


@pytest.mark.parametrize("tile", [ngramjoin.TILE, 3000, 400])
def test_against_brute_force(spark, want, tile):
    df = spark.createDataFrame(table(), SCHEMA).repartition(5)
    got = ngramjoin.components(df, tile=tile)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for *_, c in want}) < len(want) - 100


def test_tokens_of_every_link():
    """Two sets of a link share one of the tokens that count, whatever the order of those with elements."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, n + 80, dtype=np.uint64)
        more = int(rng.integers(0, n * 15 // 85 + 1))
        gone = int(rng.integers(0, n * 15 // 85 + 1))
        a, b = np.unique(base[:n]), np.unique(base[gone : n + min(more, 80)])
        both = len(np.intersect1d(a, b))
        if not len(b) or not ngramjoin.similar(both, len(a), len(b)):
            continue
        counts = [{(c, int(k)) for c, _, keys in ngramjoin.tokens(s) for k in keys} for s in (a, b)]
        order = {k: rng.random() for k in counts[0] | counts[1]}
        chosen = []
        for s in (a, b):
            own = set()
            for c, slack, keys in ngramjoin.tokens(s):
                held, empty = [int(k) for k in keys if not k & 1], [int(k) for k in keys if k & 1]
                own |= {(c, k) for k in sorted(held, key=lambda k: order[c, k])[: len(held) + slack]} | {(c, k) for k in empty}
            chosen.append(own)
        assert chosen[0] & chosen[1]


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 300)), dtype=np.uint64))
        for _ in range(rng.integers(1, 12)):
            keep = rng.random(len(base)) > rng.random() * 0.15
            sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 1 << 63, 1 + len(base) // 30, dtype=np.uint64)))))
    names = list(range(len(sets)))
    found = ngramjoin.Texts(names, names, [s.tobytes() for s in sets])
    tree = ngramjoin.CountTree(found.counts, found.sizes)
    leaf_of = {int(i): k for k, leaf in enumerate(tree.leaves) for i in leaf}
    links = [(i, j) for i, j in combinations(names, 2) if ngramjoin.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert len(links) > 100 and len(tree.levels) > 1
    for i, j in links:
        assert leaf_of[j] in tree.near(found.counts[i], len(sets[i]), len(sets[i]))


def test_query_and_empty_table(spark, tmp_path, want):
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op11_count_vector_tree(spark, str(tmp_path)).collect()), key=str) == want
    assert ngramjoin.components(spark.createDataFrame([], SCHEMA)).count() == 0
