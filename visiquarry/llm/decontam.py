"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words. A pair is looked at if it shares a seed, a run of ``SEED``
words. The longest common runs of the pair are then marked one after another without overlap (tiles of at least SEED words,
found with a running Karp-Rabin hash over the unmarked words), and a document is reported with every item of which the
tiles cover ``COVERAGE`` or more, so passages cut up and put in another order are found too.

Every run of SEED words that document and item share lies in words that seeds cover, so the tiling reads those alone.
A benchmark of at most ``BROADCAST_WORDS`` words goes to every task and documents are read once, without a shuffle; a larger
one is joined by seed, with the same result.

Defined results: null and empty texts, and items of fewer than SEED words, match nothing; repeated rows are reported as often
as they occur; null ids are kept; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, rows_in

SEED = 5
COVERAGE = 0.5
BROADCAST_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1

SCHEMA = "doc_id long, doc_key long, item_id long, item_words int, covered int, tiles int, longest int"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _scan(p: list[int], t: list[int], free_p: list[bool], free_t: list[bool], s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in p, place in t) of at least s unmarked words."""
    top = pow(_BASE, s - 1, _MOD)

    def rolling(x: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        h, n = 0, 0
        for i, w in enumerate(x):
            if not free[i]:
                h, n = 0, 0
                continue
            if n == s:
                h = (h - x[i - s] * top) % _MOD
                n -= 1
            h = (h * _BASE + w) % _MOD
            n += 1
            if n == s:
                yield i - s + 1, h

    places = defaultdict(list)
    for j, h in rolling(t, free_t):
        places[h].append(j)
    out = []
    for i, h in rolling(p, free_p):
        for j in places.get(h, ()):
            if p[i : i + s] != t[j : j + s]:
                continue
            if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                continue  # part of a run that began before
            n = s
            while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                n += 1
            out.append((n, i, j))
    return out


def tile(p: list[int], t: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (length, place in p, place in t), longest first."""
    free_p, free_t = [True] * len(p), [True] * len(t)
    tiles, s = [], max(least, 20)
    while True:
        runs = _scan(p, t, free_p, free_t, s)
        longest = max(runs, default=(0,))[0]
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                free_p[i : i + n] = free_t[j : j + n] = [False] * n
                tiles.append((n, i, j))
            else:
                again = True  # what is left of it may still be long enough
        if again and any(True for _ in _scan(p, t, free_p, free_t, s)):
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def seeds(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k known words; ids below zero are unknown words."""
    if len(ids) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.cumsum(np.concatenate([[0], ids >= 0]))
    at = np.flatnonzero(known[k:] - known[:-k] == k)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = (h ^ ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return at, h


class Index:
    """Seeds of the items, and the items as word numbers."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int):
        self.k, self.number = k, {}
        self.ids: list[int | None] = []
        self.items: list[list[int]] = []
        found = []
        for item_id, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            if len(own) >= k:
                _, h = seeds(np.array(own, np.int64), k)
                found.append((h, np.full(len(h), len(self.items))))
                self.ids.append(item_id)
                self.items.append(own)
        h, who = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((who, h))
        self.hash, self.who = h[order], who[order]

    def search(self, text: str | None, coverage: float) -> Iterator[tuple[int | None, int, int, int, int]]:
        """item, words, covered words, tiles and the longest tile, for items that the text covers enough."""
        if not text or not len(self.hash):
            return
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words(text)), np.int64)
        at, h = seeds(ids, self.k)
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero(lo < hi)
        places = defaultdict(list)
        for i in hit.tolist():
            for item in set(self.who[lo[i] : hi[i]].tolist()):
                places[item].append(int(at[i]))
        for item, own in places.items():
            p = self.items[item]
            shared = np.zeros(len(ids) + 1, bool)
            for a in own:
                shared[a : a + self.k] = True
            t: list[int] = []
            edge = np.flatnonzero(np.diff(np.concatenate([[False], shared])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                t += [*ids[a:b].tolist(), -1]
            tiles = tile(p, t, self.k)
            covered = sum(n for n, *_ in tiles)
            if tiles and covered >= coverage * len(p):
                yield self.ids[item], len(p), covered, len(tiles), tiles[0][0] if tiles else 0


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("doc_key"), text.alias("text"))


def find(docs: DataFrame, bench: DataFrame, seed: int = SEED, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for every document and item that it covers: doc_id, doc_key (hash of its text), item_id and the tiling's figures."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item is not null")
    size = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    if size > 4 * broadcast_words:  # a word and its space take four characters or more, mostly
        return _find_joined(_keyed(docs), items, seed, coverage)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            rows = [(d, k, *x) for d, k, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_key", "text"))) for x in index.value.search(t, coverage)]
            yield _batch(rows)

    return arrow_map(_keyed(docs), run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 4)], names=["doc_id", "doc_key", "item_id", "item_words", "covered", "tiles", "longest"])


def _find_joined(docs: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The same by a join on seeds, for benchmarks of any size."""

    def run_seeds(name: str, column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_in(batches):
                owner, found = [], []
                for row, text in zip(batch.column(name).to_pylist(), batch.column(column).to_pylist()):
                    w = words(text)
                    own = {" ".join(w[i : i + seed]) for i in range(len(w) - seed + 1)}
                    found += own
                    owner += [row] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(found, pa.string())], names=[name, "seed"])

        return run

    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    items = materialize(items.withColumn("nr", F.monotonically_increasing_id()), "decontam-items")
    pairs = arrow_map(docs.select("row", "text"), run_seeds("row", "text"), "row long, seed string").join(arrow_map(items.select("nr", "item"), run_seeds("nr", "item"), "nr long, seed string"), "seed").select("row", "nr").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 64):
            rows = [(d, k, i, *x[1:]) for d, k, t, i, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_key", "text", "item_id", "item"))) for x in Index([(i, item)], seed).search(t, coverage)]
            yield _batch(rows)

    return arrow_map(pairs.join(docs, "row").join(items, "nr").select("doc_id", "doc_key", "text", "item_id", "item"), run, SCHEMA)


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, without those that cover a benchmark item."""
    found = find(docs, bench, **options).select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key")).distinct()
    whole = docs.select(F.struct("*").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k"))
    left = whole.join(found, F.col("d.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left_anti")
    return left.select(*(F.col("d")[c].alias(c) for c in docs.columns))
