from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visiquarry.llm import queries
from visiquarry.llm.periodic_runs import PRIMES, Transform, _Text, detect, find_runs, zero_places


def period_of(words):
    """Smallest period by trying all."""
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words):
    """All stretches of all periods, kept where the period is the smallest."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and period_of(words[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("prime", PRIMES)
@pytest.mark.parametrize("size", [2, 8, 64])
def test_transform_multiplies(prime, size):
    p = prime[0]
    t, r = Transform(size, *prime), np.random.default_rng(size)
    a, b = r.integers(0, p, (3, size)), r.integers(0, p, (3, size))
    got = t.inverse(t.forward(a.astype(np.uint64)) * t.forward(b.astype(np.uint64)) % np.uint64(p))
    for k in range(3):
        assert got[k].tolist() == [sum(int(a[k, i]) * int(b[k, (j - i) % size]) for i in range(size)) % p for j in range(size)]


@pytest.mark.parametrize("top", [3, 70_000, 2**40])
def test_zero_places_are_exact(top):
    r = np.random.default_rng(5)
    blocks = r.integers(0, top, (20, 8))
    windows = r.integers(0, top, (20, 16))
    for k in range(0, 20, 2):
        windows[k, k // 3 : k // 3 + 8] = blocks[k]
    # one word of a place differs by little or by much: never a zero
    windows[4, 1 + 8 - 1] += 1
    windows[6, 2] = 0 if windows[6, 2] else top - 1
    want = {(k, j) for k in range(20) for j in range(8) if (windows[k, j : j + 8] == blocks[k]).all()}
    assert set(zip(*(x.tolist() for x in zero_places(blocks, windows)))) == want and len(want) >= 8


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 4)), max_size=5))
def test_runs_of_joined_repeats(parts):
    words = [x for unit, times, rest in parts for x in (unit * times + unit[:rest])]
    assert find_runs([np.array(words, np.int64)])[0] == plain_runs(words)


def test_runs_of_many_texts_at_once():
    r = np.random.default_rng(11)
    texts = [r.integers(0, r.integers(1, 4), r.integers(0, 120)).tolist() for _ in range(60)]
    assert find_runs([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_blocks_that_are_left_out_have_no_zero():
    r = np.random.default_rng(12)
    for _ in range(30):
        ids = r.integers(0, 4, 200)
        t = _Text(ids)
        for b in (1, 2, 4, 8):
            kept = set(t.blocks(b).tolist())
            for at in range(0, 200 - 2 * b, b):
                if at not in kept:
                    assert all((ids[at : at + b] != ids[at + d : at + d + b][:b]).any() for d in range(b, 2 * b) if at + d + b <= 200)


def test_long_texts():
    """One word, long periods and a long text without any; the loop over distances stays short."""
    r = np.random.default_rng(13)
    one = np.zeros(200_000, np.int64)
    unit = r.permutation(7001)
    many = np.concatenate([r.integers(8000, 9000, 500), np.tile(unit, 9)[:60_000]])
    none = np.arange(100_000)
    got = find_runs([one, many, none])
    assert got == [[(0, 200_000, 1)], [(500, 60_000, 7001)], []]


def test_query_equals_brute_force(spark, sf_dir, docs):
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, sf_dir).collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    short = [x for x in rows if len((x[1] or "").split()) <= 1500]
    have = {x[0]: x for x in got}
    assert len(got) == len(rows) and len(short) > 100
    assert [have[d] for d, _ in short] == [plain(d, t) for d, t in short]
    assert sum(x[1] > 0 for x in got) > 10


def test_odd_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in detect(odd).collect()), key=str)
    want = []
    for d, t in rows:  # no document is changed here
        x = plain(None, t if len(t or "") < 5000 else "long " * 40)
        want.append((d, *x[1:]))
    long = next(x for x in got if x[0] == 5)
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert [x for x in got if x[0] != 5] == sorted((x for x in want if x[0] != 5), key=str)
    assert detect(empty).count() == 0
    space = [(1, "a b a b a b a b a b a b"), (2, "x\ty\vx\fy\rx\ny x y"), (3, "A a A a A a A a")]
    for d, t in space:
        assert tuple(detect(spark.createDataFrame([(d, t)], "doc_id long, text string")).first()[c] for c in COLUMNS[1:]) == plain(None, t)[1:]
