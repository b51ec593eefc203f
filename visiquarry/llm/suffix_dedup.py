"""Exact substring deduplication: common strings of ``LENGTH`` bytes, found by interval expansion on Burrows-Wheeler transforms.

Within a block of texts, intervals of the suffix order are expanded breadth first by one symbol to the left on the transform;
that yields the common-prefix values in increasing order, and the expansion stops at LENGTH: boundaries that have no value by
then have common prefixes of LENGTH or more, and the suffixes beside them are the repeated starts.

Blocks come from the corpus by content. Every start of a LENGTH-byte string is keyed by the least hash of the shorter grams
inside the string, so equal strings have equal keys wherever they stand; neighbouring starts with one key form a run, and a
run's context is the bytes of its strings. Keys seen once are dropped. Equal contexts of a key are counted and kept once, so
a passage with any number of copies is one context. A key with over ``HOT`` different contexts is keyed anew, by longer
grams, up to whole strings (``GRAMS``). What is left of a key is a bounded group; groups are packed into blocks of about
``BLOCK`` bytes, each transformed in one task. Documents are read by key of their rows and never sent whole to one task.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; a null doc_id is kept; repeated rows are
copies of one another and lose all they have; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions, rows_in

LENGTH = 400
GRAMS = (200, 300, 360, 400)
HOT = 1500
BLOCK = 1 << 20
MAX_RUN = 512
PIECE = 1 << 19

_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(2**63)


class Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2**64."""

    def __init__(self, length: int) -> None:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        ones = np.ones(PIECE + length, np.uint64)
        self.up, self.down = (np.cumprod(np.where(np.arange(len(ones)) > 0, b, ones), dtype=np.uint64) for b in (_BASE, inverse))


def least_hashes(data: np.ndarray, gram: int, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every start of a ``length``-byte string the least one inside it."""
    n = len(data)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers.up[:n], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, span, least = length - gram + 1, 1, h
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return h, np.minimum(least[: len(least) - (width - span)], least[width - span :])


def runs_in(data: bytes, gram: int, length: int, powers: Powers, first: int = 0, starts: int | None = None, salt: int = 0) -> Iterator[tuple[int, int, int, int, bool]]:
    """(key, context hash, first start, starts, again) for all runs among ``starts`` starts from ``first`` on.

    again: the run has its least gram more than once, so it may hold one string twice.
    """
    total = len(data) - length + 1 - first if starts is None else starts
    for at in range(0, total, PIECE):
        count = min(PIECE, total - at)
        lo = first + at
        h, least = least_hashes(np.frombuffer(data, np.uint8, count + length - 1, lo), gram, length, powers)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        begin, end = np.append(0, cut), np.append(cut, count)
        if (end - begin).max() > MAX_RUN:
            begin = np.concatenate([np.arange(b, e, MAX_RUN) for b, e in zip(begin, end)])
            end = np.append(begin[1:], count)
        keys = ((least[begin] ^ np.uint64(salt & (2**64 - 1))) * _BASE).view(np.int64).tolist()
        for k, least_one, b, e in zip(keys, least[begin], begin.tolist(), end.tolist()):
            again = e - b > 1 and np.count_nonzero(h[b : e + length - gram] == least_one) > 1
            yield k, xxhash.xxh3_64_intdigest(data[lo + b : lo + e + length - 1]) - 2**63, lo + b, e - b, again


RUNS = "id long, text_key long, key long, context long, start int, starts int, again boolean"


def _rows(columns: list[list], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names=names)


def _transposed(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]


def first_runs(texts: DataFrame, gram: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(length)
        for batch in rows_in(batches):
            rows = [(i, k, *r) for i, k, d in zip(*(batch.column(c).to_pylist() for c in ("id", "text_key", "data"))) if d and len(d) >= length for r in runs_in(d, gram, length, powers)]
            yield _rows(_transposed(rows, 7), RUNS)

    return arrow_map(texts, run, RUNS)


def finer_runs(texts: DataFrame, hot: DataFrame, gram: int, length: int) -> DataFrame:
    """The runs of hot keys, cut and keyed anew by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(length)
        for batch in rows_in(batches, 64):
            rows = [
                (i, k, *r)
                for i, k, d, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text_key", "data", "own")))
                for o in own
                for r in runs_in(d, gram, length, powers, o["start"], o["starts"], o["key"])
            ]
            yield _rows(_transposed(rows, 7), RUNS)

    own = hot.groupBy("id", "text_key").agg(F.collect_set(F.struct("key", "start", "starts")).alias("own"))
    return arrow_map(texts.join(own, ["id", "text_key"]).select("id", "text_key", "data", "own"), run, RUNS)


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling. Symbols are 1 and up; every 0 is an end of its own, in order of place."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        s = np.where(open_, padded[k : k + n], 0)
        open_ &= s > 0
        key = key << 9 | s
    sa = np.argsort(key, kind="stable")
    ks, alone = key[sa], ~open_[sa]
    head = np.ones(n, bool)
    head[1:] = (ks[1:] != ks[:-1]) | alone[1:] | alone[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    depth = 7
    while len(slots):
        own = sa[slots]
        pair = rank[own] * n + rank[own + depth]
        order = np.argsort(pair, kind="stable")
        own, pair = own[order], pair[order]
        sa[slots] = own
        head = np.ones(len(slots), bool)
        head[1:] = pair[1:] != pair[:-1]
        rank[own] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        depth *= 2
    return sa, rank


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of which the next ``length`` symbols also begin at another place (ends, 0, are equal to nothing)."""
    n = len(symbols)
    sa, rank = suffix_order(symbols)
    before = sa - 1
    inner = (before >= 0) & (symbols[before] > 0)  # others would be extended by an end: a string seen once
    left = np.where(inner, rank[before], -1)  # the transform's step to the left, as a place in the suffix order
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    first = symbols[sa]
    head = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0)))
    low, high = head, np.append(head[1:], n)
    known[high] = True
    for _ in range(1, length):
        if not len(low):
            break
        width = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        to, interval = left[at], np.repeat(np.arange(len(low)), width)
        ok = to >= 0
        to, interval = to[ok], interval[ok]
        if not len(to):
            break
        order = np.argsort(to)
        to, interval = to[order], interval[order]
        symbol = symbols[sa[to]]
        head = np.flatnonzero(np.append(True, (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])))
        low, high = to[head], np.append(to[head[1:] - 1], to[-1]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        order = np.argsort(low)
        low, high = low[order], high[order]
    far = ~known
    return sa[far[:-1] | far[1:]]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(starts, cut)] if len(starts) else []


FOUND = "key long, context long, lo int, hi int"


def transform_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """(key, context, lo, hi): ranges of starts, counted from the context's first, whose strings are repeated."""

    def block(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        data = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", np.uint8)
        symbols = data.astype(np.int16) + 1
        ends = np.cumsum([len(r[3]) + 1 for r in rows]) - 1
        symbols[ends] = 0
        found = np.sort(repeated_starts(symbols, length))
        begin = ends - [len(r[3]) for r in rows]
        for (key, context, copies, _), b, lo, hi in zip(rows, begin, np.searchsorted(found, begin), np.searchsorted(found, ends)):
            own = [(0, int(len(_) - length + 1))] if copies > 1 else _ranges(found[lo:hi] - b)
            for a, z in own:
                yield key, context, a, z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "copies", "data"))):
                if size > BLOCK and row[0] != rows[-1][0]:
                    yield _rows(_transposed(list(block(rows)), 4), FOUND)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield _rows(_transposed(list(block(rows)), 4), FOUND)

    n = partitions(contexts.sparkSession)
    return arrow_map(contexts.repartition(n, "key").sortWithinPartitions("key"), run, FOUND)


def contexts_of(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """Bytes of the chosen contexts (key, context, copies, at), read where ``at`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 64):
            rows = [(o["key"], o["context"], o["copies"], d[o["start"] : o["start"] + o["starts"] + length - 1]) for d, own in zip(batch.column("data").to_pylist(), batch.column("own").to_pylist()) for o in own]
            yield _rows(_transposed(rows, 4), "key long, context long, copies long, data binary")

    own = chosen.groupBy("at.id", "at.text_key").agg(F.collect_list(F.struct("key", "context", "copies", "at.start", "at.starts")).alias("own"))
    return arrow_map(texts.join(own, ["id", "text_key"]).select("data", "own"), run, "key long, context long, copies long, data binary")


def intervals(texts: DataFrame, runs: DataFrame, length: int, grams: tuple[int, ...], hot: int) -> DataFrame:
    """(id, text_key, lo, hi): bytes of each document covered by repeated strings."""
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    shared = materialize(runs.join(keys, "key"), "dedup-runs")
    each = shared.groupBy("key", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "text_key", "start", "starts")).alias("at"), F.max("again").alias("again"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    each = materialize(each.join(sizes, "key"), "dedup-contexts")
    last = len(grams) == 1
    alone = each.where("different = 1 and copies > 1").select("key", "context", F.lit(0).alias("lo"), F.col("at.starts").alias("hi"))
    work = each.where("(different > 1 or copies = 1 and again)" + ("" if last else f" and different <= {hot}"))
    found = alone.union(transform_blocks(contexts_of(texts, work, length), length))
    out = shared.join(found, ["key", "context"]).select("id", "text_key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length - 1).alias("hi"))
    heavy = each.where(f"different > {hot}").select("key").distinct()
    if last or heavy.isEmpty():
        return out
    finer = materialize(finer_runs(texts, shared.join(heavy, "key"), grams[1], length), "dedup-finer")
    return out.union(intervals(texts, finer, length, grams[1:], hot))


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>"
_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def merged(own: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(own):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """One row per document: bytes, removed bytes, removed spans, digest of the rest and, ``with_kept``, the rest itself."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    runs = materialize(first_runs(texts, grams[0], length), "dedup-first")
    own = intervals(texts, runs, length, grams, hot).groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            rows = []
            for i, data, own in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "own"))):
                spans = merged([(o["lo"], o["hi"]) for o in own or ()])
                at, kept = 0, []
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                rest = b"".join([*kept, data[at:]])
                rows.append((None if i == _NULL_ID else i, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"lo": a, "hi": b} for a, b in spans], rest if with_kept else None))
            cols = _transposed(rows, 7)
            kinds = [pa.int64()] * 4 + [pa.string(), _SPAN, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return arrow_map(texts.join(own, ["id", "text_key"], "left").select("id", "data", "own"), cut, DONE + ", kept binary")
