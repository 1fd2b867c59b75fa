"""Learned abbreviations: planted ones don't split, counts and scores as in plain arithmetic; places within groups."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import abbreviations
from quire.operators.numbering import numbered


def prose(seed=1, n=400):
    rng = random.Random(seed)
    words = ["house", "tree", "river", "walks", "sings", "under", "bright", "stone", "opens", "never"]
    out = []
    for _ in range(n):
        said = rng.choices(words, k=rng.randint(4, 9))
        if rng.random() < 0.5:
            said[1:1] = [rng.choice(["Dr.", "Mr.", "(e.g.", "St."]), rng.choice(["Smith", "Jones"])]
        out.append(" ".join(said).capitalize() + ".")
    return out


def plain(texts):
    found = Counter()
    for text in texts:
        for token in re.split(r"[ \t\n\x0b\f\r]+", text.lower()):
            token = token.strip("\"'“”‘’«»()[]{},;:!?…")
            word = token[:-1] if token.endswith(".") else token
            if word and not word.endswith(".") and re.search(r"[^\W\d_]", word):
                found[word, token.endswith(".")] += 1
    dots, everything = sum(n for (_, d), n in found.items() if d), sum(found.values())
    p, out = dots / everything, {}
    for word in {w for w, d in found if d}:
        a, b, k = found[word, True], found[word, False], len(word.replace(".", ""))
        ratio = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
        score = ratio * math.exp(-k) * (word.count(".") + 1) * k**-b
        if score >= 0.3:
            out[word] = score
    return out


def test_planted_abbreviations_are_learned_and_do_not_split(spark):
    lines = prose()
    df = spark.createDataFrame([("en", " ".join(lines[i : i + 20])) for i in range(0, len(lines), 20)] + [("xx", "a. b. c."), ("xx", None), (None, "Only. one.")], "lang string, text string")
    found = abbreviations.learned(abbreviations.counts(df))
    got = {r["word"]: r["score"] for r in found.where("lang = 'en'").collect()}
    want = plain([t for lang, t in ((r["lang"], r["text"]) for r in df.collect()) if lang == "en"])
    assert set(got) == set(want) and {"dr", "mr", "e.g", "st"} <= set(got)
    assert all(got[w] == pytest.approx(want[w]) for w in want)
    assert found.where("lang = 'xx' or lang is null").count() == 0  # every word ends in a stop
    split = abbreviations.with_sentences(df, found).where("lang = 'en'").collect()
    assert [s for r in split for s in r["sentences"]] == lines
    others = abbreviations.with_sentences(df, found).where("lang is null or lang = 'xx'").collect()
    assert sorted((r["sentences"] or [] for r in others), key=len) == [[], ["Only.", "one."], ["a.", "b.", "c."]]


def test_places_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i if rng.random() < 0.95 else None) for i in rng.sample(range(-300, 300), 400)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = {(r["k"], r["v"]): r["nth"] for r in numbered(df.where("v is not null"), ["k"], "v", width=7).collect()}
    for k in ("a", "b", None):
        own = sorted(v for x, v in rows if x == k and v is not None)
        assert [got[k, v] for v in own] == list(range(1, len(own) + 1))
    nulls = numbered(df, ["k"], "v", 0, 7)
    assert nulls.where("v is null").agg(F.max("nth")).first()[0] < max(Counter(k for k, v in rows if v is None).values())
