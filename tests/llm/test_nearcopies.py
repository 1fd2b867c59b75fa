import random
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import nearcopies
from quire.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def similar(a, b):
    return a == b or bool(a and b) and len(a & b) / len(a | b) >= 0.8


def texts():
    """Texts with copies at many similarities, a chain, and a large group of near copies."""
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    changed = lambda words, at: [("x%d" % rng.randrange(10**6) if i in at else w) for i, w in enumerate(words)]
    out = []
    for n in (12, 60, 200, 800):
        base = prose(n)
        out += [base, *(changed(base, set(rng.sample(range(n), max(1, round(n * share))))) for share in (0.004, 0.01, 0.015, 0.03, 0.06, 0.1))]
    chain = prose(300)
    for _ in range(5):
        out.append(chain)
        chain = changed(chain, set(rng.sample(range(300), 4)))
    base = prose(150)
    out += [changed(base, {rng.randrange(150)}) for _ in range(40)]
    out += [prose(rng.choice([1, 3, 5, 50])) for _ in range(20)]
    return [*(" ".join(w) for w in out), " ".join(base).upper(), "", " \n", None]


def roots(found):
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(found)), 2):
        if similar(found[i], found[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(found))]


def test_stage_keeps_one_of_copies_at_four_fifths(spark):
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(texts())]
    want = [i for i, r in enumerate(roots([sets(t) for _, t, *_ in rows])) if i == r]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < len(rows) - 50
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_stage_keeps_one_row_of_a_component_whatever_its_id(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(4000)}" for _ in range(200)) for _ in range(4))
    docs = [(None, f"{a} more"), (3, a), (None, b), (None, f"{b} more"), (5, c), (5, d), (4, d)]
    df = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in docs], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == 4 and {(3, a), (5, c), (4, d)} < set(got) and (set(got) & {(None, b), (None, f"{b} more")})


def family(n, seed):
    """Mutated copies of one text at all similarities, many of them under the threshold with all others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    return [" ".join("x%d" % rng.randrange(10**6) if rng.random() < i % 12 / 250 else w for w in base) for i in range(n)]


def agree(got, want):
    return len({(got[i], want[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_large_groups_in_tiles(spark):
    found = family(420, 9)
    df = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(found)], SCHEMA)
    want = roots([sets(t) for t in found])
    for tile in (nearcopies.ngramjoin.TILE, 4000):
        got = {r["doc_id"]: r["root"] for r in nearcopies.components(df, tile=tile).collect()}
        assert len(set(want)) > 30 and agree(got, want)


def test_templates_are_no_candidates(spark):
    """Texts that share half their words with all others: a few of them are copies, and only those become candidates."""
    rng = random.Random(8)
    shared = [f"w{rng.randrange(4000)}" for _ in range(100)]
    made = [" ".join(shared + [f"w{rng.randrange(4000)}" for _ in range(100)]) for _ in range(600)]
    made += [t + " more" for t in made[:20]]
    df = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(made)], SCHEMA)
    got = {r["doc_id"]: r["root"] for r in nearcopies.components(df).collect()}
    assert len(set(got.values())) == 600 and all(got[i] == got[600 + i] for i in range(20))
    scratch = Scratch(spark, "templates")
    parsed = nearcopies.ngramjoin.parsed_texts(df.select("doc_id", F.col("text").alias("t")), 80, 5)
    lots = nearcopies.ngramjoin.candidates(scratch.put(parsed, "parsed"), scratch)
    assert lots.count() < 120 and lots.groupBy("lot").count().agg(F.max("count")).first()[0] < 20
