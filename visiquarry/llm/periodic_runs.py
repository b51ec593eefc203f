"""Periodic runs in documents by block convolution.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no neighbouring word
extends. At scale b (1, 2, 4, ...) the words are cut into blocks of b. A run with b <= q < 2 b has 4 b words or more, so one
whole block lies in its first 2 b - 1 words and occurs again q words later, still inside the run. The sum of squared
differences between a block and every place of the 2 b words that follow is |block|^2 + |place|^2 - 2 block . place; the
products of all places come from one cyclic convolution of 2 b numbers, done by number-theoretic transforms modulo primes whose
product exceeds every possible sum, so a sum is zero exactly if no word differs. Each such distance d seeds an extension to the
left and to the right; what is long enough, and has no shorter period, is a run.

Blocks that cannot have a zero are left out beforehand, without changing the result: if a word of the block does not occur
again within 2 b words, no place matches; if block and window lie inside a known run of period at most b, its places are
multiples of that period. The transforms of all blocks of one scale, over many documents, are made at once.

Defined results: a null or empty text has no words and no runs (0, four nulls, digests of the empty string); a null doc_id is
read like any other document; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_in

LEAST, TIMES = 6, 4
#: primes k * 2^26 + 1 and more, below 2^31, with a generator of their multiplicative groups; fixed values
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: numbers in one array of transforms
AT_ONCE = 1 << 19
ROWS = 128
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


class Transform:
    """Forward and inverse transforms of the rows of 2-D arrays, for one power of two and one prime."""

    def __init__(self, size: int, prime: int, generator: int) -> None:
        self.p, self.size = np.uint64(prime), size
        self.roots, self.inverse_roots = [], []
        n = size
        while n > 1:
            w = pow(generator, (prime - 1) // n, prime)
            self.roots.append(self._powers(w, n // 2, prime))
            self.inverse_roots.append(self._powers(pow(w, -1, prime), n // 2, prime))
            n //= 2
        self.scale = np.uint64(pow(size, -1, prime))

    @staticmethod
    def _powers(w: int, n: int, prime: int) -> np.ndarray:
        out, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(w, done, prime)) % np.uint64(prime)
            done += more
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Decimation in frequency: natural order in, bit-reversed order out."""
        rows, n, p = len(x), self.size, self.p
        for w in self.roots:
            x = x.reshape(rows, -1, 2, n // 2)
            a, b = x[:, :, 0], x[:, :, 1]
            x = np.stack([(a + b) % p, (a + (p - b)) * w % p], axis=2)
            n //= 2
        return x.reshape(rows, -1)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        """Decimation in time: bit-reversed order in, natural order out."""
        rows, n, p = len(x), 2, self.p
        for w in reversed(self.inverse_roots):
            x = x.reshape(rows, -1, 2, n // 2)
            a, b = x[:, :, 0], x[:, :, 1] * w % p
            x = np.stack([(a + b) % p, (a + (p - b)) % p], axis=2)
            n *= 2
        return x.reshape(rows, -1) * self.scale % p


def zero_places(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lag) where a block of b numbers equals its window of 2 b numbers from the lag on, for lags under b.

    The sums of squared differences are computed modulo as many primes as make them exact.
    """
    b = blocks.shape[1]
    top = int(max(blocks.max(), windows.max()))
    bound, zero, modulus = b * top * top, None, 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        t = Transform(2 * b, prime, generator)
        x, y = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        # products of the block with every place: a convolution with the block turned round
        turned = np.zeros_like(y)
        turned[:, 0], turned[:, 2 * b - b + 1 :] = x[:, 0], x[:, :0:-1]
        dots = t.inverse(t.forward(turned) * t.forward(y) % p)[:, :b]
        squares = np.concatenate([np.zeros((len(y), 1), np.uint64), np.cumsum(y * y % p, axis=1)], axis=1)
        there = (squares[:, b : 2 * b] - squares[:, :b]) % p
        own = (x * x % p).sum(1, dtype=np.uint64)[:, None] % p
        now = (own + there + np.uint64(2) * (p - dots)) % p == 0
        zero = now if zero is None else zero & now
        modulus *= prime
        if modulus > bound:
            break
    else:
        raise ValueError("a block is too long for exact sums")
    return np.nonzero(zero)


def modified(ids: np.ndarray, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) of a document whose words from a on repeat its words a .. a + p - 1; None for the others."""
    n = len(ids)
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class _Text:
    """One document: word numbers, the places of next occurrences, and the runs found so far."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, n = ids, len(ids)
        order = np.argsort(ids, kind="stable")
        same = ids[order[:-1]] == ids[order[1:]]
        self.ahead = np.full(n, np.iinfo(np.int64).max)
        self.ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
        self.runs: list[tuple[int, int, int]] = []
        self.seen: dict[int, list[tuple[int, int]]] = {}

    def blocks(self, b: int) -> np.ndarray:
        """First words of the blocks of b that can occur again b to 2 b - 1 words later."""
        n = len(self.ids)
        first = np.arange(0, min(n // b * b, n - 2 * b + 1), b)
        if not len(first):
            return first
        whole = self.ahead[: n // b * b].reshape(-1, b)[: len(first)].max(1)
        first = first[whole < 2 * b]
        for start, length, period in self.runs if len(first) else ():
            if period <= b:
                first = first[(first < start) | (np.minimum(first + 3 * b, n) > start + length)]
        return first

    def seed(self, at: int, b: int, d: int) -> None:
        """Words at .. at + b - 1 occur again d words later: extend, and keep a run."""
        for s, n, q in self.runs:
            if d % q == 0 and s <= at and at + b + d <= s + n:
                return
        for s, e in self.seen.get(d, ()):
            if s <= at < e:
                return
        right, left = self.equal(at + b, d), self.equal_back(at, d)
        start, length = left, right + d - left
        self.seen.setdefault(d, []).append((left, right))
        if length >= max(LEAST, TIMES * d) and self.smallest(start, length, d):
            self.runs.append((start, length, d))

    def equal(self, i: int, d: int) -> int:
        """The first place from i on whose word differs from the one d later."""
        n, step = len(self.ids) - d, 16
        while i < n:
            to = min(n, i + step)
            differ = np.flatnonzero(self.ids[i:to] != self.ids[i + d : to + d])
            if len(differ):
                return i + int(differ[0])
            i, step = to, 2 * step
        return i

    def equal_back(self, i: int, d: int) -> int:
        step = 16
        while i > 0:
            to = max(0, i - step)
            differ = np.flatnonzero(self.ids[to:i] != self.ids[to + d : i + d])
            if len(differ):
                return to + int(differ[-1]) + 1
            i, step = to, 2 * step
        return i

    def smallest(self, start: int, length: int, d: int) -> bool:
        """Whether no shorter period holds: as the stretch is longer than 2 d, a shorter one divides d."""
        own, rest, f = self.ids[start : start + length], d, 2
        factors = set()
        while f * f <= rest:
            while rest % f == 0:
                factors.add(f)
                rest //= f
            f += 1
        if rest > 1:
            factors.add(rest)
        return all((own[: -(d // r)] != own[d // r :]).any() for r in factors)


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period), by start and period, of every run of each list of word numbers."""
    own = [_Text(ids) for ids in texts]
    b = 1
    while any(len(t.ids) >= 4 * b for t in own):
        some = [(t, at) for t in own if len(t.ids) >= max(LEAST, 4 * b) for at in t.blocks(b).tolist()]
        rows = max(1, AT_ONCE // (2 * b))
        for lo in range(0, len(some), rows):
            part = some[lo : lo + rows]
            blocks, windows = np.empty((len(part), b), np.int64), np.empty((len(part), 2 * b), np.int64)
            for k, (t, at) in enumerate(part):
                blocks[k] = t.ids[at : at + b]
                there = t.ids[at + b : at + 3 * b]
                windows[k, : len(there)] = there
                windows[k, len(there) :] = len(t.ids)  # no word of the document has this number
            for row, lag in zip(*(x.tolist() for x in zero_places(blocks, windows))):
                t, at = part[row]
                t.seed(at, b, b + lag)
        b *= 2
    return [sorted(t.runs, key=lambda r: (r[0], r[2])) for t in own]


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that a run contains after its first period."""
    turns = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return np.cumsum(turns[:n]) > 0


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def detect(docs: DataFrame, change: Callable[[np.ndarray, int | None], tuple[int, int] | None] | None = None) -> DataFrame:
    """Runs of every document, the greatest one, and digests of all runs and of the words that stay.

    ``change`` names documents whose words are repeated before the search, as ``modified`` does.
    """

    def read(text: str | None, doc_id: int | None) -> tuple[list[bytes], np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if change is not None and (how := change(ids, doc_id)) is not None:
            a, p = how
            at = np.concatenate([np.arange(a), a + np.arange(len(ids) - a) % p])
            ids, words = ids[at], [words[i] for i in at.tolist()]
        return words, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, ROWS):
            names = batch.column("doc_id").to_pylist()
            given = [read(t, d) for t, d in zip(batch.column("text").to_pylist(), names)]
            rows = []
            for name, (words, ids), runs in zip(names, given, find_runs([ids for _, ids in given])):
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                gone = dropped(len(ids), runs) if runs else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append({
                    "doc_id": name, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
                    "runs_sha256": _digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), "collapsed_sha256": _digest(b" ".join(kept)),
                    "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, RESULT)


_LONGS = ("start", "length", "period")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in (*_LONGS, "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in _LONGS])))])
