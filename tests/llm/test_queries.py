"""Every opN_ query and the pipeline over tiny tables: columns, formats, and rows that are out of the ordinary."""

import random
import re

import pytest

import corpus_pipeline
from quire.llm import queries

HEX = re.compile(r"[0-9a-f]{64}")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, node long, row long, spans int",
    "labels": "doc_id long, quality int, toxic int, text string",
    "pages": "page_id long, url string, html string, host int, verdict int, text int",
    "embeddings": "vec_id long, embedding array<float>, list int, score string",
    "conversations": "conv_id long, turn long, role string, text string, seq int, codes string, cost long",
}
COLUMNS = {
    "op1_run_length_index": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_host_reputation": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_decision_list": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_chunked_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_minimax_partition": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_cross_parsing": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_dimension_scan": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_segment_popcount": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_tag_path_ratio": "page_id bigint, url string, text string, n_chars bigint",
    "op11_count_vector_tree": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_cost_layers": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


def rows():
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice(("the", "ing", "er", "th", "on")) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].upper(), "", " \n ", None, "🙂 ß\u0301\u3000x\x00y", prose(60000), "a" * 300000, "\n".join(["same line here"] * 40)]
    docs = [(i, t, "en" if i % 2 else "de", "hot" if i % 3 else None, len(t or ""), "k", 1, 2, 3, 4) for i, t in enumerate(texts)]
    docs += [docs[3], (3, "another text of the same id", None, "x", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    labels = [(i, i % 2, 0, "clash") for i in range(0, 40, 2)] + [(1, None, None, None), (None, 1, 1, None), (0, 0, 1, "x")]
    pages = [(i, f"http://h{i % 3}.example.com/en/{i}", f"<article><h1>T{i}</h1><p>{texts[i]}</p></article>", 1, 2, 3) for i in range(20)]
    pages += [pages[0], (None, None, None, None, None, None), (99, "x", "", 1, 1, 1), (98, "a://b.net/" + "9" * 30, "<p>" + "word " * 200000, 1, 1, 1)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], 1, "s") for i in range(120)]
    vectors += [vectors[50], (200, None, 1, None), (250, [0.0] * 8, 1, None), (None, [1.0] * 8, 1, None), (300, [float("nan")] * 8, 1, None)]
    turns = [(i // 5, i % 5, rng.choice(["user", "assistant", "system", None]), rng.choice([prose(4) + ".", prose(3), None, ""]), 1, "x", 2) for i in range(60)]
    turns += [turns[3], turns[3], (None, None, None, None, None, None, None), (-1, 2**63 - 1, "user", "a" * 200000, 1, "x", 2), (-1, -(2**63), "", " ", 1, "x", 2)]
    return {"documents": docs, "labels": labels, "pages": pages, "embeddings": vectors, "conversations": turns}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name, found in rows().items():
        spark.createDataFrame(found, SCHEMAS[name]).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, folders, name):
    full, empty = folders
    query = queries.queries()[name]
    df = query(spark, full)
    if name in COLUMNS:
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[: COLUMNS[name].count(",") + 1]) == COLUMNS[name]
    got, tables = df.collect(), rows()
    if name == "op2_conflict_best_fit":
        assert sum(r["piece_bytes"] for r in got) == sum(len((d[1] or "").encode()) for d in tables["documents"])
    elif name == "op8_dimension_scan":
        assert {r["query_id"] for r in got} == {0, 50, 100} and sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 3)
    elif name == "op12_source_divergence":
        assert {(r["lang"], r["source"]) for r in got} == {(d[2] or "", d[3] or "") for d in tables["documents"]}
    elif name == "op13_cost_layers":
        assert sorted(str(r[0]) for r in got) == sorted({str(t[0]) for t in tables["conversations"]})
    else:
        table = "pages" if name in ("op3_host_reputation", "op10_tag_path_ratio") else "documents"
        assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in tables[table])
    for r in got:
        for field in r.asDict():
            if field.endswith("sha256"):
                assert HEX.fullmatch(r[field])
            if field == "fingerprint":
                assert re.fullmatch("[0-9a-f]{16}", r[field])
            if field == "score":
                assert -1.0000001 <= r[field] <= 1.0000001
    assert query(spark, empty).count() == 0


def test_pipeline_over_odd_rows_and_none(spark, folders):
    full, empty = folders
    got = corpus_pipeline.run(spark, full).collect()
    assert {r["doc_id"] for r in got} <= set(range(50)) and len(got) > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
