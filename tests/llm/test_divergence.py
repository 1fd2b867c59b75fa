"""The divergence audit against its SQL and against plain arithmetic, with ties, nulls and languages without kept terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from quire.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, n int, terms string"


def table():
    rng = random.Random(5)
    words = ["The", "the", "É", "é", "naïve", "a1b", "x_y", "日本", "İ", "K", "z"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "é", None])
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), lang, source, i, "x"))
    rows += [rows[3], rows[3], (None, None, "en", "a", 1, None), (999, "only once", "rare", "a", 1, None), (998, "12 34", "rare", "b", 1, None), (997, "b" * 200000, "en", "b", 1, None)]
    return rows


def plain(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = sorted(s for g, s in groups if g == lang)
        share = lambda c, total: 1 + 1000000000 * (c + 1) // (total + len(kept))
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in own}
        q = {t: share(sum(counts[lang, s][t] for s in own), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    df = spark.createDataFrame(table(), SCHEMA).repartition(4)
    for top in (200, 3):
        assert sorted(map(tuple, divergence.audit(df, top=top).collect())) == plain(table(), top=top)


def test_query_and_sql(spark, tmp_path):
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_source_divergence(spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and [t for _, t in got.dtypes][4:] == ["bigint", "int"]
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(queries.OP12_SQL).fetchall())


def test_share_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 10 ** rng.randint(1, 15))
        count, kept = rng.randrange(total + 1), rng.randrange(1, 10**6)
        got = divergence.share(np.array([count]), np.array([total]), kept)[0]
        assert got == 1 + 10**9 * (count + 1) // (total + kept)


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 64)
    df = spark.createDataFrame(table(), SCHEMA).coalesce(1)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain(table())


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
