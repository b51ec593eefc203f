from __future__ import annotations

import hashlib
import re

import pytest

from visiquarry.llm import fingerprints, queries


def test_query_equals_plain_code(spark, sf_dir, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in queries.QUERIES["op3_winnowing"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    sets = {}
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets[doc_id] = {int(x, 16) >> 24 for x in r.fingerprint.split(",")}
        changed = {int(x, 16) >> 24 for x in r.edited_fingerprint.split(",")}
        assert r.near_edited == pytest.approx(len(sets[doc_id] & changed) / len(sets[doc_id] | changed))
    for k, (doc_id, _) in enumerate(rows):
        a, b = sets[doc_id], sets[rows[(k + 1) % len(rows)][0]]
        assert got[doc_id].near_next == pytest.approx(len(a & b) / len(a | b))


def test_winnowing_keeps_rightmost_least_grams(spark):
    text = " ".join(f"w{i * i % 23}" for i in range(200))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = re.findall(r"\S{1,16}", text)
    hashed = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").selectExpr("xxhash64(w)").collect()]
    mask = 2**64 - 1
    rotate = lambda x, by: ((x << by) | (x >> (64 - by))) & mask
    u = [h & mask for h in hashed]
    grams = [rotate(u[i], 3) ^ rotate(u[i + 1], 2) ^ rotate(u[i + 2], 1) ^ u[i + 3] for i in range(len(u) - 3)]
    kept = []
    for s in range(len(grams) - 7):
        best = min(range(s, s + 8), key=lambda i: (grams[i] >> 25, -i))
        if best not in kept:
            kept.append(best)
    got = fingerprints.fingerprint(frame).first()["kept"]
    assert [(2**24 - 1) - (v & (2**24 - 1)) for v in got] == kept
    assert [v >> 24 for v in got] == [grams[i] >> 25 for i in kept]


def test_odd_and_empty_tables(odd, empty):
    rows = fingerprints.compare_edited(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({tuple(r.kept) for r in rows if r.n_chars == 0}) == 1
    assert fingerprints.compare_edited(empty).count() == 0
    assert fingerprints.compare_edited(odd.limit(1)).first().near_next == 1.0


def test_plans_stay_native(spark, sf_dir):
    plan = queries.QUERIES["op3_winnowing"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
