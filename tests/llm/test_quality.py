import math
import random
import re
from collections import Counter

import numpy as np

from quire.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(6)
    vocab = ["a", "b", "é", "Wort", "c#", "|", "\xa0x", "d\x1ce"]
    out = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "\x0b", "  "]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    return [*out, None, "", " \n", "a b c a b c", "x", "l\nl\n l\nl "]


def test_statistics_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a a a a"), (3, texts()[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[:6]) for r in quality.statistics(df).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_learned_list(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + ("###" if bad else "") for _ in range(80))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    labels += [(5000, 1), (None, 0), (7, None)]
    df, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.statistics(df)
    rules = quality.learn(stats, named.where("doc_id < 600 or doc_id is null"))
    assert rules and all(len(r) <= 3 for r in rules)
    got = {r["doc_id"]: r["kept"] for r in stats.select("doc_id", quality.verdict(rules).alias("kept")).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(900))
    assert quality.learn(stats, named.where("doc_id < 0")) == []
    short = quality.statistics(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"))
    assert [r[0] for r in short.select(quality.verdict([])).collect()] == [False, False]


def plain_rule(x, bad, grid):
    """The best first condition by trying every threshold that the learner may use."""
    best, pick = 1e-9, None
    p0, n0 = sum(bad), len(bad) - sum(bad)
    base = math.log2(p0 / (p0 + n0))
    for name, values in x.items():
        ordered = sorted(set(values))
        cuts = set()
        for q in np.quantile(values, np.linspace(0, 1, grid + 1)[1:-1]):
            above = [v for v in ordered if v > q]
            cuts.add((q + (above[0] if above else ordered[-1])) / 2)
        for cut in sorted(cuts):
            for up in (True, False):
                inside = [b for v, b in zip(values, bad) if (v > cut) == up]
                p = sum(inside)
                if p and (gain := p * (math.log2(p / len(inside)) - base)) > best + 1e-12:
                    best, pick = gain, (name, up, float(cut))
    return pick, best


def test_grown_condition_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(20, 120))
        x = {"a": rng.integers(0, 9, n).astype(float), "b": rng.random(n)}
        bad = rng.random(n) < np.where(x["a"] > 5, 0.8, 0.2)
        if not bad.any() or bad.all():
            continue
        got = quality._grow(x, bad, 1, 16)
        pick, best = plain_rule({k: v.tolist() for k, v in x.items()}, bad.tolist(), 16)
        hit = got[0].holds(x)
        p = bad[hit].sum()
        assert abs(p * (math.log2(p / hit.sum()) - math.log2(bad.mean())) - best) < 1e-9 and (got[0].feature, got[0].above) == pick[:2]


def test_verdict_follows_the_list_in_its_order(spark):
    rng = random.Random(6)
    c = quality.Condition
    rules = [(c("symbols_per_word", True, 0.5), c("upper_per_char", False, 0.4)), (c("duplicate_lines", True, 0.3),)]
    rows = []
    for i in range(200):
        words = rng.choice([0, 10, 49, 50, 51, 200])
        rows.append((i, words, *(rng.randint(0, 1 + words) for _ in range(8))))
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{s} long" for s in quality.STATS))
    got = {r["doc_id"]: r["kept"] for r in df.select("doc_id", quality.verdict(rules).alias("kept")).collect()}
    for i, *values in rows:
        s = dict(zip(quality.STATS, values))
        ratio = lambda f: (lambda t, b: s[t] / s[b] if s[b] else 0.0)(*quality.FEATURES[f])
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        hit = any(all((ratio(k.feature) > k.threshold) == k.above for k in rule) for rule in rules)
        assert got[i] == (not failed and not hit), s
    assert quality.learn(df, spark.createDataFrame([], "doc_id long, quality int")) == []
