from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from visiquarry.llm import queries, suffix_dedup
from visiquarry.llm.suffix_dedup import dedup, repeated_starts

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length):
    rows = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(d[i : i + length] for _, d in rows for i in range(len(d) - length + 1))
    out = collections.Counter()
    for k, d in rows:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        rest = bytes(x for x, m in zip(d, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[k, len(d), len(d) - len(rest), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def got(frame):
    return collections.Counter(tuple(r) for r in frame.select(*COLUMNS).collect())


def test_expansion_finds_repeated_starts():
    r = random.Random(1)
    for _ in range(120):
        length = r.choice([1, 2, 3, 5, 9])
        parts = [bytes(r.choice(b"ab\0c"[: r.choice([1, 2, 4])]) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        symbols[ends] = 0
        places, at = collections.defaultdict(list), 0
        for p in parts:
            for i in range(len(p) - length + 1):
                places[p[i : i + length]].append(at + i)
            at += len(p) + 1
        assert set(repeated_starts(symbols, length).tolist()) == {x for v in places.values() if len(v) > 1 for x in v}


@pytest.mark.parametrize(("length", "grams", "hot"), [(20, (8, 12, 20), 4), (40, (20, 30, 40), 2)])
def test_equals_brute_force_with_hot_keys(spark, length, grams, hot):
    r = random.Random(3)
    base = ["".join(r.choice("abé ") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(90):
        cuts = [(r.choice(base), r.randint(0, 200), r.randint(5, 90)) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(b[a : a + n] for b, a, n in cuts)))
    rows += [(0, rows[0][1]), (None, rows[5][1]), (500, None), (501, "a" * 15), (502, "a" * 700 + "x"), (503, base[0] * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(dedup(frame, length, grams, hot)) == brute(rows, length)


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op1_suffix_dedup"](spark, sf_dir)) == brute(rows, suffix_dedup.LENGTH)


def test_odd_and_empty_tables(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(dedup(odd)) == brute(rows, suffix_dedup.LENGTH)
    assert dedup(empty).count() == 0
