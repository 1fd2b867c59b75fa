import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import bpe
from quire.llm.queries import vocabulary

PATH = vocabulary()
tokenizers = pytest.importorskip("tokenizers")
EXACT = tokenizers.Tokenizer.from_file(PATH)
ALPHABET = st.sampled_from(list("abcXYZ 019.,'!-\n\t\r") + ["  ", " the", "'s", "'ll", "é", "ß", "中", "\xa0", " ", "\x85", "​", "😀", "<|endoftext|>", "\x00", "\x1c"])


def joined(text, mask=7):
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    cuts, safe = bpe.chunk_cuts(data, offsets, mask)
    raw = text.encode()
    parts = [raw[a:b] for a, b, _ in bpe.pieces(0, len(data), cuts, safe)]
    assert b"".join(parts) == raw
    return b"".join(bpe.codec(PATH).encode(p.decode()) for p in parts)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_chunked_ids_are_those_of_the_whole_text(text):
    want = EXACT.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(want)}I", joined(text))) == want
    assert bpe.decode_ids(joined(text), PATH) == EXACT.decode(want, skip_special_tokens=False)


def test_table(spark):
    shared = " ".join(f"passage number {i} of words" for i in range(400))
    texts = [shared, "x " + shared + "\n\ny", None, "", " ", "a" * 5000, shared, "<|endoftext|> " + shared, "naïve  café 中文\tend "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, shared)], "doc_id long, text string")
    for r in bpe.encode(df, PATH).collect():
        text = shared if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = EXACT.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).digest()
        assert r["decoded"] == EXACT.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.where("doc_id = 99"), PATH).count() == 0


def test_small_cache_gives_the_same(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(600))) for i in range(20)], "doc_id long, text string")
    assert sorted(bpe.encode(df, PATH, cache_bytes=3000).collect()) == sorted(bpe.encode(df, PATH).collect())
