from __future__ import annotations

import random
import re

import numpy as np
import pytest

from visiquarry.llm import blobs, graph, queries, setjoin
from visiquarry.llm.common import materialize
from visiquarry.llm.words import Words


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by, seen = {}, {}
    for i, s in enumerate(sets):
        if s:
            if s in seen:
                parent[root(i)] = root(seen[s])
                continue
            seen[s] = i
            shared = {}
            for x in s:
                for j in by.setdefault(x, []):
                    shared[j] = shared.get(j, 0) + 1
                by[x].append(i)
            for j, n in shared.items():
                if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if not sets[i] else least.get(root(i))
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(words, share, r):
    return [w if r.random() > share else f"x{r.randrange(10**6)}" for w in words]


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(queries.op12_minhash(spark, sf_dir)) == want
    assert sum(not r[3] for r in want) > 5


def test_sets_are_those_of_the_contract():
    texts = [None, "", "a b", "A b", "a b c d", "a\tb\vc  d a b c d", "x y z"]
    sets = setjoin.shingle_sets(texts, Words())
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[2].tolist() == sets[3].tolist() and sets[4][0] in sets[5].tolist()


def test_screen_passes_the_similarity_asked_for():
    r = np.random.default_rng(3)
    assert 30 < setjoin.fewest_equal(0.8) < 40
    for n in (20, 400):
        sets = []
        for _ in range(300):  # pairs of exactly 0.8: 8 of 10 in common
            x = r.integers(0, 2**63, n // 10 * 10, dtype=np.uint64)
            k = n // 10
            sets += [np.unique(x[: 9 * k]), np.unique(x[k:])]
        s = setjoin.sketch(sets)
        sizes = np.array(list(map(len, sets)))
        assert setjoin.alike(sizes[::2], sizes[1::2], s[::2], s[1::2], 0.8).all()
        assert not setjoin.alike(sizes[::2], np.roll(sizes[1::2], 1), s[::2], np.roll(s[1::2], 1, axis=0), 0.8).any()


def test_wide_parity_tells_large_sets_apart():
    """Sets of 4,000 shingles: the narrow screen passes pairs of 0.7, the wide one does not, and neither fails a pair of 0.8."""
    r = np.random.default_rng(4)
    for similarity, passes in ((0.7, False), (0.8, True)):
        for sizes in ((4000, 4000), (4000, 4300)):  # of 8,192 and of 16,384 bits
            both = int(sum(sizes) * similarity / (1 + similarity)) + 1
            x = r.integers(0, 2**63, sum(sizes), dtype=np.uint64)
            a, b = np.unique(x[: sizes[0]]), np.unique(np.concatenate([x[:both], x[sizes[0] : sum(sizes) - both]]))
            n, m = np.array([len(a)]), np.array([len(b)])
            differ = setjoin.wide_differ([setjoin.wide_parity(a), setjoin.wide_parity(b)], np.array([0]), np.array([1]))
            assert (differ <= setjoin.may_differ(n, m, 0.8)).all() == passes
            s = setjoin.sketch([a, b])
            assert setjoin.alike(n, m, s[:1], s[1:], 0.8).all()


def test_roots_choose_different_coordinates():
    roots = setjoin.root_choices()
    assert len({k for _, k in roots}) == len(roots) == 12 and {t for t, _ in roots} == set(range(setjoin.TREES))


@pytest.mark.parametrize("small", [8192, 4])
def test_groups_boilerplate_and_chains(spark, monkeypatch, small):
    """Groups of near copies, a passage that half of all texts share, and chains that only links between members connect.

    With SMALL = 4 most nodes branch, and those left after DEPTH levels are compared in tiles.
    """
    monkeypatch.setattr(setjoin, "SMALL", small)
    monkeypatch.setattr(setjoin, "TILE", min(small, setjoin.TILE))
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(150):  # own words around the passage
        rows.append([*(word() for _ in range(r.randrange(20, 60))), *(passage if i % 2 else []), *(word() for _ in range(10))])
    base = [word() for _ in range(120)]
    rows += [edited(base, 0.02, r) for _ in range(60)]
    step = [word() for _ in range(100)]
    for _ in range(15):  # a chain: each changes the end of the one before
        step = [*step[8:], *(word() for _ in range(8))]
        rows.append(step)
    rows += [rows[0]] * 3 + [["a", "b"], ["A", "b"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(setjoin.cluster(frame)) == plain(rows)


def test_odd_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted(((d, n, c, True if d is None and c is None else k) for d, n, c, k in plain(rows)), key=str)
    assert got(setjoin.cluster(odd)) == want
    assert setjoin.cluster(empty).count() == 0


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    from visiquarry.llm import graph

    rounds, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    for edges, want, most in (([(5, 1), (2, 1), (9, 7)], {1: 1, 2: 1, 5: 1, 7: 7, 9: 7}, 0), ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0), 6), ([(3, 2), (3, 1), (4, 4)], {1: 1, 2: 1, 3: 1}, 1), ([], {}, 0)):
        rounds.clear()
        found = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)
        assert rounds.count("stars") <= most


@pytest.mark.parametrize("share", [1 << 18, 3])
def test_components_of_shares_of_links(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "SHARE", share)
    r = random.Random(share)
    links = [(i, i + 1) for i in range(12)] + [(40, 30 + i) for i in range(9)] + [(r.randrange(50, 90), r.randrange(50, 90)) for _ in range(25)] + [(95, 95)]
    least = {x: x for link in links[:-1] for x in link}
    for _ in least:
        for a, b in links[:-1]:
            least[a] = least[b] = min(least[a], least[b])
    rounds = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    assert {tuple(x) for x in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()} == set(least.items())
    if share > len(links):
        assert rounds == ["links", "forests"]  # one share of the links needs no round
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bits_are_fetched_in_one_job(spark):
    keys = [r.id * 7919 for r in spark.range(3000).collect()]
    spark.sparkContext.setJobGroup("bits-of-keys", "bits")
    bits = blobs.bit_set(spark.createDataFrame([(k,) for k in keys], "key long"), 1 << 20)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bits-of-keys")
    spark.sparkContext.setJobGroup("other", "other")
    want = np.zeros(1 << 20, bool)
    want[[k & (1 << 20) - 1 for k in keys]] = True
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == want).all()
    assert len(jobs) <= 2  # not one for each shuffle partition
