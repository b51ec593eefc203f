from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from visiquarry.llm import packing, queries

TEXTS = ["It's 12³ ¼ÀÈ's don't 'sss can''t ²x_y  a\x85b\xa0c ß ÿ Ÿ Ω Σας ſ", "a<|endoftext|>b", "", "   ", "ΑΣ ΟΔΟΣ.", "é x", "1.2.3 $$$'s'", "İstanbul I ĳ ŉ ǅ\x1cz", "x" * 5000, "one two " * 4000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_cache_equals_the_tokenizer(tokenizer):
    encoder = packing.WordEncoder(queries.tokenizer_path(), 50)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(TEXTS)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_decomposition():
    for n in (1, 2, 3, 4095, 4096, 4097, 12_345):
        parts = packing.pieces(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def check(frame, texts, tokenizer):
    by_doc = collections.defaultdict(list)
    for r in frame.collect():
        by_doc[r.doc_id].append(r)
    assert len({r.sequence_id for rows in by_doc.values() for r in rows}) == sum(map(len, by_doc.values()))
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_query_round_trip(spark, sf_dir, docs, tokenizer):
    check(queries.QUERIES["op4_pack"](spark, sf_dir), {r.doc_id: r.text for r in docs.collect()}, tokenizer)


def test_odd_and_empty_tables(spark, odd, empty, tokenizer):
    rows = packing.pack(odd, queries.tokenizer_path())
    assert rows.where("doc_id = 4").agg({"length": "sum"}).first()[0] == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in [r.text for r in odd.where("doc_id = 4").collect()])
    assert rows.where("doc_id = 1").select("length").collect()[0][0] == 1
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(packing.pack(frame, queries.tokenizer_path()), dict(enumerate(TEXTS)), tokenizer)
