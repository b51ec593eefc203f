from __future__ import annotations

import random

from visiquarry.llm import queries
from visiquarry.llm.decontam import COVERAGE, decontaminate, find, tile, words


def test_tiles_of_reordered_passages():
    assert sorted(tile([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [7, 8, 9, 10, 11, 12, -1, 1, 2, 3, 4, 5, 6])) == [(6, 0, 7), (6, 6, 0)]
    assert tile([1, 2, 3], [4, 5, 6]) == []


def greedy(p, t, least):
    """The longest common run of free words, again and again."""
    free_p, free_t, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free_p[i : i + n] = free_t[j : j + n] = [False] * n
        out.append(best)


def test_tiling_equals_plain_greedy():
    r = random.Random(5)
    for _ in range(150):
        p, t = ([r.randint(0, 3) for _ in range(r.randint(0, 40))] for _ in range(2))
        assert sum(n for n, *_ in tile(p, t, 3)) == sum(n for n, *_ in greedy(p, t, 3))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            p, t = words(item), words(text)
            grams = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if any(tuple(p[i : i + 5]) in grams for i in range(len(p) - 4)):
                covered = sum(n for n, *_ in greedy(p, t, 5))
                if covered >= COVERAGE * len(p):
                    out.append((doc_id, item_id, covered))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.item_id, r.covered) for r in queries.QUERIES["op10_decontam"](spark, sf_dir).collect()), key=str) == brute(rows, items)


def test_join_on_seeds_gives_the_same(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    a, b = (sorted((tuple(r) for r in find(docs, bench, broadcast_words=n).collect()), key=str) for n in (10**6, 0))
    assert a == b and a


def test_odd_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the same id with another text"), (None, None), (3, "x")], "item_id long, text string")
    assert [tuple(r)[:1] for r in find(odd, bench).select("doc_id").collect()] == [(4,)]
    left = decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert find(empty, bench).count() == 0
    assert decontaminate(odd, bench.limit(0)).count() == odd.count()
