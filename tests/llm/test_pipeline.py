import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import langid, quality
from tests.llm.test_nearcopies import roots as similar_roots, sets
from tests.llm.test_repeats import brute

PARTS = {"aa": ["the", "ing", "er", "th", "on", "wh"], "bb": ["ung", "sch", "ä", "ein", "ver", "pf"]}


def fixture():
    rng = random.Random(12)

    def prose(lang, n):
        return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 5))) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))

    shared = prose("aa", 60)
    docs, labels = [], []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        text = prose(lang, rng.randint(60, 300))
        if i % 9 == 0:
            text += shared
        bad = i % 5 == 0
        if bad:
            text = text.replace(" ", "## ")
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(200 + i, docs[7 + i][1], "aa", "s0", 1) for i in range(5)]
    words = docs[8][1].split(" ")
    docs += [(300, " ".join([*words[:-1], "other"]), "aa", "s1", 1), (400, None, "aa", None, None), (401, "12 34", "aa", "s0", 5), (402, "x\x01" * 300, "bb", "s0", 1)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, (docs, labels) = tmp_path_factory.mktemp("pipeline"), fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows(df):
    return rows_of(tuple(r) for r in df.collect())


def rows_of(found):
    return sorted(found, key=str)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        out[name] = (rows(before), rows(docs), docs.columns)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert all(cols == names for _, _, cols in list(out.values())[:-1])

    before, after, _ = out["language_id"]
    parser = langid.train(spark.read.parquet(f"{folder}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    want = []
    for r in before:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        bits = parser.bits(raw, np.array([0, len(raw)])).min() if len(raw) else 0
        if any(c.isalpha() for c in r[1] or "") and not (bits > 5 and len(raw) >= 100):
            want.append(r)
    assert after == want and {r[0] for r in before} - {r[0] for r in after} == {400, 401, 402}

    before, after, _ = out["quality_rules"]
    kept = {r[0] for r in after}
    for r in before:
        n, _, symbols, _, again, *_ = quality.measure(r[1].encode())
        assert (r[0] in kept) == (n >= 50 and 100 * again <= 50 * n and "##" not in r[1]), r[0]

    before, after, _ = out["simhash_near_dedup"]
    before = sorted(before)
    roots = similar_roots([sets(r[1]) for r in before])
    assert after == rows_of(r for i, r in enumerate(before) if roots[i] == i) and len(after) < len(before)

    before, after, _ = out["suffix_array_dedup"]
    raw = [r[1].encode() for r in before]
    for r, t, gone, b in zip(sorted(after, key=lambda r: str(r)), raw, brute(raw, 200), before):
        assert r[0] == b[0] and r[1] == bytes(x for i, x in enumerate(t) if i not in gone).decode("utf-8", "ignore") and r[4] == len(r[1])
    assert any(len(r[1]) < len(b[1]) for r, b in zip(after, before))

    before, after, _ = out["best_fit_packing"]
    sizes, bins = defaultdict(int), defaultdict(list)
    for doc, _, _, n, bin_, _, source in after:
        sizes[doc] += n
        bins[bin_].append((n, source))
    assert sizes == {r[0]: len(r[1].encode()) for r in before}
    assert all(sum(n for n, _ in b) <= 8192 and len({s for _, s in b}) == len(b) for k, b in bins.items() if k is not None)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start_byte", "piece_bytes", "bin_id", "bin_offset", "source"] and got.count() > 50
