import math
import random

import numpy as np

from quire.llm import langid


def words(lang, rng, n):
    parts = {"aa": ["the", "ing", "er", "th", "on"], "bb": ["ung", "sch", "ä", "ein", "ver"], "cc": ["eau", "é", "tion", "ou", "la"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        count += 1
        at = max(at + 1, end - 1)
    return count


def test_parse_against_substring_search():
    rng = random.Random(2)
    samples = {k: langid.normalise(np.frombuffer(words(k, rng, 300).encode(), np.uint8), np.array([0, len(words(k, random.Random(2), 1))]))[0].tobytes() for k in ("aa", "bb")}
    texts = [words(rng.choice(["aa", "bb", "cc"]), rng, n) for n in (1, 5, 40, 300)] + ["Ünï X9!!zz"]
    parser = langid.CrossParser.fit(samples, block=50)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = parser.bits(data, offsets)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        clean = langid.normalise(raw, np.array([0, len(raw)]))[0].tobytes()
        for j, sample in enumerate(samples.values()):
            n = sum(phrases(clean[a : a + 50], sample) for a in range(0, len(clean), 50))
            assert math.isclose(got[i, j], n * math.log2(len(sample)) / len(clean))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, words(lang, rng, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = langid.train(df.where("doc_id < 200"), docs_per_lang=20, train_bytes=4096)
    got = {r["doc_id"]: r for r in langid.identify(df, parser, keep=("lang", "text")).collect()}
    held = [got[i] for i in range(200, 300)]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 98
    assert all(0 <= r["score"] <= 1 for r in held) and got[3]["text"] == rows[3][1]
    odd = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "12 !?", "x"), (None, "the thing", "y"), (3, "12 !?", "x"), (4, "Ж", "z")], df.schema)
    found = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in langid.identify(odd, parser).collect())
    assert [x for x in found if x[0] in "123"] == [("1", "und", 0.0), ("2", "und", 0.0), ("3", "und", 0.0), ("3", "und", 0.0)]
    assert [x[1] for x in found if x[0] == "None"] == ["aa"] and [x[1] for x in found if x[0] == "4"] != ["und"]
    none = langid.train(df.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("doc_id < 0"), parser).count() == 0


def test_sample_is_bounded_and_drawn_from_whole_texts(spark):
    text = "".join(chr(97 + i * 26 // 60000) for i in range(60000))
    rows = [(i % 30, text, "aa") for i in range(600)] + [(1000 + i, text.upper(), "bb") for i in range(3)] + [(None, text, "aa"), (5000, None, "cc"), (1, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample_texts(df, "lang", "doc_id", "text", 8, 4096, 256, 1 << 18)
    assert set(got) == {"aa", "bb"} and all(len(v) <= 4096 + 8 * 8 for v in got.values())
    assert set(got["bb"]) >= set(b"adlz")  # stretches from the first letters to the last
    assert all(len(v) <= 200 for v in langid.sample_texts(df, "lang", "doc_id", "text", 8, 4096, 256, 300).values())
    assert set(langid.sample_texts(df, "lang", "doc_id", "text", 8, 4096, 1, 1 << 18)) == {"aa"}


def test_long_text_and_clashing_columns(spark):
    rows = [(i, "the other thing with her " * 40, "en", 1, "x") for i in range(10)] + [(10 + i, "der und schon ein ver " * 40, "de", 1, "x") for i in range(10)]
    df = spark.createDataFrame([*rows, (99, "the thing " * 300000, None, 2, "y")], "doc_id long, text string, lang string, bits long, lang_pred string")
    parser = langid.train(df)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, parser).collect()}
    assert got[99] == "en" and got[3] == "en" and got[13] == "de" and langid.identify(df.where("false"), parser).count() == 0
