from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from visiquarry.llm import queries, simhash_dedup
from visiquarry.llm.graph import components
from visiquarry.llm.simhash_dedup import Golay, cluster, fuzzy_keys, keep_one


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    own = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    ones = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> i & 1 for x in own) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(own))


def grouped(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def expected(rows):
    fps = np.array([plain(t) for _, t in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    own = grouped(zip(a.tolist(), b.tolist()), range(len(rows)))
    least = {}
    for i, g in own.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], int(fps[i]), least.get(own[i])) for i in range(len(rows))), key=str)


def test_golay_keys_meet_within_two_bits():
    golay = Golay()
    r = np.random.default_rng(2)
    words = r.integers(0, 1 << 23, 300)
    for w in words.tolist():
        other = w ^ sum(1 << int(b) for b in r.choice(23, r.integers(0, 3), replace=False))
        keys = [set(golay.keys(np.array([x]))[1].tolist()) for x in (w, other)]
        assert keys[0] & keys[1] and all(len(k) in (1, 6) for k in keys)


def test_keys_meet_within_four_bits():
    golay, r = Golay(), np.random.default_rng(3)
    fps = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    for fp in fps:
        other = fp
        for b in r.choice(64, r.integers(0, 5), replace=False):
            other ^= np.uint64(1 << int(b))
        keys = [set(fuzzy_keys(np.array([x], np.uint64), golay)[1].tolist()) for x in (fp, other)]
        assert keys[0] & keys[1]


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op9_simhash"](spark, sf_dir).collect()), key=str)
    assert got == expected(rows)


def test_hot_keys_are_dealt_anew(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, r.integers(0, 6), replace=False))) for b in base for _ in range(60)], np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = grouped(zip(a.tolist(), b.tolist()), range(len(fps)))
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for hot in (3, 10**6):
        monkeypatch.setattr(simhash_dedup, "HOT", hot)
        links = [(at[x.a], at[x.b]) for x in simhash_dedup.links(frame, 4).collect()]
        assert grouped(links, range(len(fps))) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (4, 9), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_equals_brute_force(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    own = grouped(links, range(len(rows)))
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(rows[i][0] for i in own if own[i] == i)


def test_odd_and_empty_tables(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in cluster(odd).collect()), key=str)
    assert got == expected(rows)
    assert cluster(empty).count() == 0
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 4").count() == 2
    assert keep_one(empty).count() == 0


@pytest.mark.parametrize("text", [None, "", "One", "one two three four", "one two three four five SIX"])
def test_fingerprint_of_short_texts(text):
    assert simhash_dedup.fingerprint(text) == plain(text)


def test_copies_of_a_text_enter_the_candidate_search_once(spark, monkeypatch):
    rows = [(i, "one and the same text in many rows " * 3) for i in range(40)] + [(50, "another text"), (51, None), (52, "")]
    seen, own = [], simhash_dedup._candidates
    monkeypatch.setattr(simhash_dedup, "_candidates", lambda frame: seen.append(frame.count()) or own(frame))
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 50, 51]
    assert seen == [3]


def kept_by_brute_force(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    own = grouped(links, range(len(rows)))
    return sorted(rows[i][0] for i in own if own[i] == i)


def test_truncated_and_appended_copies_are_found(spark):
    r = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in r.integers(0, 3000, n)]
    rows = []
    for share in (0.79, 0.8, 0.82, 0.85, 0.9, 0.95):
        for n in (150, 300, 700):
            text, runs = words(n), n - 4
            rows += [text, text[: 4 + int(np.ceil(share * runs))], text + words(int(runs / share) - runs)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    assert sorted(x.doc_id for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == kept_by_brute_force(rows)


def test_members_apart_from_the_centre_keep_their_links(spark, monkeypatch):
    """Windows over one long text: each is similar to its neighbours only, and far ones share no large group's centre."""
    monkeypatch.setattr(simhash_dedup, "sketches", lambda words: [0] * len(simhash_dedup.SKETCHES))
    r = np.random.default_rng(7)
    text = [f"w{x}" for x in r.integers(0, 3000, 1600)]
    rows = [(i, " ".join(text[20 * i : 20 * i + 250])) for i in range(60)]
    assert kept_by_brute_force(rows) == [0]
    assert [x.doc_id for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
