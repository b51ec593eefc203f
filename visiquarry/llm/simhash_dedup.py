"""SimHash near-duplicates with Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit set where over half of its shingle hashes have it set. Fingerprints that differ in
at most four bits are linked, and connected documents are one component.

Candidates come from keys. The fingerprint is cut into three segments of 21, 21 and 22 bits, each read as a word of the
perfect binary Golay code [23, 12, 7]. Two words that differ in at most two bits lie both within four bits of one codeword,
so the one or six codewords within four bits are the word's keys. Four errors leave one of two cases: a segment without
error and another with at most two (key: the first segment, a codeword of the second); or errors of 1, 1 and at most 2 (key:
one half of either of the two segments, exact, and a codeword of the third). So no link is missed. Fingerprints with equal
keys meet in a task and are verified there by their differing bits; a key that very many fingerprints share is dealt anew by
any four of the eight bytes, of which four errors leave at least four untouched.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; a null
doc_id is kept and never names a component unless all its documents have none; repeated rows share a component; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bit_set, gaps, in_bits, keys_of, packed, parts_of, unpacked
from .common import arrow_map, materialize, partitions, rows_in
from .graph import components
from .words import BASE, MIX, Words, mixed

SHINGLE, SEED, BITS = 4, 42, 4
HOT = 4096
_NO_ID = -(2**63)
_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the XXH64 hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = _BYTE_BITS[lanes].sum(0).reshape(-1)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


class Golay:
    """Codewords of the [23, 12, 7] code near given 23-bit words."""

    GENERATOR = 0b101011100011

    def __init__(self) -> None:
        def rest(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= self.GENERATOR << (i - 11)
            return v

        self.low = np.array([rest(v) for v in range(1 << 12)], np.int64)
        self.high = np.array([rest(v << 12) for v in range(1 << 11)], np.int64)
        of = lambda places: sum(1 << i for i in places)
        errors = [of(p) for w in range(4) for p in combinations(range(23), w)]
        self.error = np.zeros(1 << 11, np.int64)
        self.error[[rest(e) for e in errors]] = errors
        sevens = [c for c in ((m << 11) ^ rest(m << 11) for m in range(1 << 12)) if c.bit_count() == 7]
        # what to add to a word with this syndrome to get each codeword within four bits; -1: no more
        self.steps = np.full((1 << 11, 6), -1, np.int64)
        for s, e in enumerate(self.error.tolist()):
            own = [e] + ([e ^ c for c in sevens if c & e == e] if e.bit_count() == 3 else [])
            self.steps[s, : len(own)] = own

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, codeword) for all codewords within four bits of each word."""
        steps = self.steps[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        at, k = np.nonzero(steps >= 0)
        return at, words[at] ^ steps[at, k]


def fuzzy_keys(fps: np.ndarray, golay: Golay, halves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for every key of every fingerprint; fps: uint64. Without ``halves``, the first case alone."""
    v = fps.astype(np.uint64)
    seg = [(v & np.uint64(0x1FFFFF)).astype(np.int64), (v >> np.uint64(21) & np.uint64(0x1FFFFF)).astype(np.int64), (v >> np.uint64(42)).astype(np.int64)]
    near = [golay.keys(s) for s in seg]
    at, keys, family = [], [], 0
    for j in range(3):
        who, code = near[j]
        i, k = (x for x in range(3) if x != j)
        exact = [seg[i], seg[k]] + ([] if not halves else [((seg[i] >> 11 * a) & 0x7FF) << 11 | (seg[k] >> 11 * b) & 0x7FF for a in range(2) for b in range(2)])
        for e in exact:
            at.append(who)
            keys.append(np.int64(family) << 46 | e[who] << 23 | code)
            family += 1
    return np.concatenate(at), np.concatenate(keys)


def byte_keys(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As fuzzy_keys, within one hot key: any four of the eight bytes."""
    lanes = fps.astype(np.uint64)[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
    keys = []
    for n, four in enumerate(combinations(range(8), 4)):
        h = np.full(len(fps), (key * 70 + n) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in four:
            h = (h ^ lanes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys.append(h.view(np.int64))
    return np.tile(np.arange(len(fps)), 70), np.concatenate(keys)


def links_within(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints (distinct) that differ in at most ``bits`` bits.

    Every fingerprint is held once against those not reached yet, so memory stays that of the list.
    """
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue:
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= bits
            new = rest[near].tolist()
            rest = rest[~near]
            out += [(x, y) for y in new]
            queue += new
    return out


def meet(records: DataFrame, bits: int, defer: bool) -> DataFrame:
    """(a, b, deferred) from (key, fp) records: verified links between fingerprints that share a key.

    Rows of a key come sorted, so they form a run. With ``defer`` a run of over HOT rows is passed on, as (key, fp, true).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, deferred) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(deferred, pa.bool_())], names=["a", "b", "deferred"])

        def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(keys)) + 1
            first, last = np.append(0, cut), np.append(cut, len(keys))
            size = last - first
            # runs of two, the usual case, all at once
            two = first[size == 2]
            x, y = fps[two], fps[two + 1]
            ok = (np.bitwise_count(x ^ y) <= bits) & (x != y)
            yield out(x[ok].view(np.int64), y[ok].view(np.int64), np.zeros(int(ok.sum()), bool))
            a, b = [], []
            for s, e in zip(first[size > 2].tolist(), last[size > 2].tolist()):
                own = np.unique(fps[s:e])
                if defer and len(own) > HOT:
                    yield out(np.full(len(own), keys[s]), own.view(np.int64), np.ones(len(own), bool))
                    continue
                for i, j in links_within(own, bits):
                    a.append(own[i])
                    b.append(own[j])
            if a:
                yield out(np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64), np.zeros(len(a), bool))

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield from settle(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield from settle(keys, fps)

    n = partitions(records.sparkSession)
    return arrow_map(records.repartition(n, "key").sortWithinPartitions("key"), run, "a long, b long, deferred boolean")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that connect what is connected among distinct fingerprints at most ``bits`` (4 at most) bits apart."""
    if bits > 4:
        raise ValueError("the keys hold for at most four differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in rows_in(batches, 4096):
            own = batch.column("fp").to_numpy().view(np.uint64)
            at, keys = fuzzy_keys(own, golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own[at].view(np.int64), pa.int64())], names=["key", "fp"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 4096):
            keys, own = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            for key in np.unique(keys).tolist():
                at, finer = byte_keys(key, own[keys == key])
                yield pa.RecordBatch.from_arrays([pa.array(finer, pa.int64()), pa.array(own[keys == key][at].view(np.int64), pa.int64())], names=["key", "fp"])

    met = materialize(meet(arrow_map(fps.select("fp").distinct(), keyed, "key long, fp long"), bits, True), "simhash-links")
    hot = met.where("deferred").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    found = met.where("not deferred").select("a", "b")
    if hot.isEmpty():
        return found
    return found.union(meet(arrow_map(hot, again, "key long, fp long"), bits, False).select("a", "b"))


def cluster(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every document."""
    own = materialize(fingerprints(docs, shingle), "simhash")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = components(links(own, bits))
    least = nodes.join(member, nodes.fp == member.node).groupBy("component").agg(F.min("first").alias("least"))
    named = member.join(least, "component").select(F.col("node").alias("fp"), "least")
    named = materialize(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-named")
    # two plain shuffles: the join can be split where very many documents have one fingerprint
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


WORDS, SIMILARITY = 5, 0.8
SKETCHES = ((1, 42), (1, 43), (1, 44), (2, 42))
ALL_PAIRS, FAR = 6, 12
LATE, LATE_HASH, BITS_KEPT = 5, 40, 1 << 26
PARITY = 4
PAIRS_AT_ONCE = 1 << 19


def sketches(words: np.ndarray) -> list[int]:
    """Fingerprints of the set of words under three seeds, and of the set of word pairs: a text and a near copy of it
    differ there in few bits, as an edited word spoils one word or two pairs, but five runs of five words."""
    out = []
    for size, seed in SKETCHES:
        own = np.unique(words if size == 1 or len(words) < 2 else mixed(words[:-1] * BASE + words[1:]))
        ones = np.unpackbits(mixed(own ^ np.uint64(seed * int(MIX) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]))
    return out


def word_runs(texts: list[str | None], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, sorted hashes of the set of five-word runs) of each text; of fewer words the whole is the one run."""
    seq, n = words.read(texts)
    every = seq.copy()
    for k in range(1, WORDS):
        every = mixed(every * BASE + np.roll(seq, -k))
    at = 0
    for m in (n - 1).tolist():
        own = seq[at : at + m]
        if m < WORDS:
            whole = np.full(1, m, np.uint64)
            for x in own:
                whole = mixed(whole * BASE + x)
        yield own, np.unique((whole if m < WORDS else every[at : at + m - WORDS + 1]).view(np.int64))
        at += m + 1


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of similarity t share at least t n runs of either, so under any common order of runs the first
    n - ceil(t n) + 1 of both have one in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _late(texts: DataFrame) -> np.ndarray:
    """Bits for the runs that LATE or more texts of the whole table have.

    These runs come last in the order that counts. Any set of runs gives the same links; this one keeps passages that many
    texts share out of the prefixes. Tasks send sorted hashes of LATE_HASH bits with counts, and the texts of a run are
    added in one task. A bit stands for all runs with its hash, so the set has BITS_KEPT bits at any size.
    """
    n_parts = partitions(texts.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cut = parts_of(keys, LATE_HASH, n_parts).tolist()
            rows = [(p, gaps(keys[a:b]), packed(n[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["part", "keys", "n"])

        for batch in rows_in(batches):
            held += [own.view(np.uint64) & np.uint64((1 << LATE_HASH) - 1) for _, own in word_runs(batch.column("text").to_pylist(), words)]
            if sum(map(len, held)) > 2 << 20:
                yield flush()
                held = []
        if held:
            yield flush()

    def often(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([keys_of(b) for b in rows.column("keys").to_pylist()])
        n = np.concatenate([unpacked(b) for b in rows.column("n").to_pylist()])
        own, at = np.unique(keys, return_inverse=True)
        return pa.table({"key": pa.array(own[np.bincount(at, n, len(own)) >= LATE].view(np.int64))})

    keys = arrow_map(texts.select("text"), tell, "part int, keys binary, n binary").groupBy("part").applyInArrow(often, "key long")
    return bit_set(keys, BITS_KEPT)


def _features(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """text_key, sketches, n (different runs of five words), prefix, parity0 and on (bits: whether an odd number of runs
    hash there):
    one row of every different text, so that copies of one text count once. Tasks reduce what they read before the shuffle, and texts are not shuffled."""
    late = texts.sparkSession.sparkContext.broadcast(_late(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = late.value, Words()
        for batch in rows_in(batches):
            every, sizes, prefixes, parity = [], [], [], []
            for words_own, own in word_runs(batch.column("text").to_pylist(), words):
                last = in_bits(bits, own)
                odd = np.bincount((own.view(np.uint64) >> np.uint64(48) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                every.append(np.array(sketches(words_own), np.uint64).view(np.int64))
                sizes.append(len(own))
                prefixes.append(np.concatenate([own[~last], own[last]])[: prefix_length(len(own), similarity)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(every, longs), pa.array(sizes, pa.int32()), pa.array(prefixes, longs), *(pa.array([p[k] for p in parity], pa.int64()) for k in range(PARITY))], names=["text_key", "sketches", "n", "prefix", *(f"parity{k}" for k in range(PARITY))])

    return arrow_map(texts.select("text_key", "text"), run, "text_key long, sketches array<long>, n int, prefix array<long>" + "".join(f", parity{k} long" for k in range(PARITY))).dropDuplicates(["text_key"])


def _prefix_pairs(features: DataFrame, member: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): all pairs of texts not yet in one component that share a run of both prefixes and can still be similar.

    Every pair of the similarity is among them or already connected: sizes must allow it, what follows the first run in
    common must hold enough of others, and bits of parity differ in no more places than runs may. The rows of a run are sorted by component, and a row meets only those of later
    components, PAIRS_AT_ONCE at a time, so groups of near copies that the sketches connected cost nothing.
    """
    bits = [f"parity{k}" for k in range(PARITY)]
    known = features.select("text_key", "n", "prefix", *bits).join(member.select(F.col("node").alias("text_key"), "component"), "text_key", "left")
    records = known.select(F.posexplode("prefix").alias("at", "key"), F.col("text_key").alias("name"), F.coalesce("component", "text_key").alias("component"), "n", *bits)
    records = records.select("key", "name", "component", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("size_at"), *bits)

    def settle(keys, names, group, size_at, *parity) -> Iterator[pa.RecordBatch]:
        n, at, rows = size_at >> 32, size_at & 0xFFFFFFFF, np.arange(len(keys))
        ends = lambda new: np.repeat(np.append(np.flatnonzero(new)[1:], len(keys)), np.diff(np.append(np.flatnonzero(new), len(keys))))
        other = np.append(True, keys[1:] != keys[:-1])
        key_end, group_end = ends(other), ends(other | np.append(True, group[1:] != group[:-1]))
        meets = key_end - group_end
        upto = np.cumsum(meets)
        lo = 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            some = meets[lo:hi]
            x = np.repeat(rows[lo:hi], some)
            y = group_end[x] + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            shared = np.minimum(n[x] - at[x], n[y] - at[y])
            ok = (least >= similarity * most - 1e-9) & (shared * (1 + similarity) >= similarity * (n[x] + n[y]) - 1e-6)
            x, y = x[ok], y[ok]
            differ = sum(np.bitwise_count((p[x] ^ p[y]).view(np.uint64)).astype(np.int64) for p in parity)
            ok = differ * (1 + similarity) <= (1 - similarity) * (n[x] + n[y]) + 1e-6
            if ok.any():
                a, b = names[x[ok]], names[y[ok]]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("key", "name", "component", "size_at", *bits)]
            kept = new if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, new)]
            whole = int(np.searchsorted(kept[0], kept[0][-1]))
            if whole:
                yield from settle(*(x[:whole] for x in kept))
                kept = [x[whole:] for x in kept]
        if kept is not None:
            yield from settle(*kept)

    n = partitions(features.sparkSession)
    return arrow_map(records.repartition(n, "key").sortWithinPartitions("key", "component"), run, "a long, b long").distinct()


def _candidates(features: DataFrame) -> DataFrame:
    """(a, b): pairs of text keys that share a Golay key of a sketch: one exact segment and a codeword of another."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in rows_in(batches):
            every = np.array(batch.column("sketches").to_pylist(), np.int64).view(np.uint64).reshape(-1, len(SKETCHES))
            names = batch.column("text_key").to_numpy()
            for s in range(len(SKETCHES)):
                at, keys = fuzzy_keys(every[:, s], golay, halves=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys | np.int64(s) << 52, pa.int64()), pa.array(names[at], pa.int64()), pa.array(every[at, s].view(np.int64), pa.int64())], names=["key", "name", "fp"])

    def meet_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(keys: np.ndarray, names: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(keys)) + 1
            first, last = np.append(0, cut), np.append(cut, len(keys))
            size = last - first
            a, b = [], []
            for n in range(2, ALL_PAIRS + 1):  # runs of one size at once, all pairs
                at = first[size == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        ok = np.bitwise_count(fps[at + i] ^ fps[at + j]) <= FAR
                        a.append(names[at + i][ok])
                        b.append(names[at + j][ok])
            for s, e in zip(first[size > ALL_PAIRS].tolist(), last[size > ALL_PAIRS].tolist()):
                # a large group: its most central member with all near it, then the same for those left; members that this
                # leaves unlinked meet in _prefix_pairs
                own, fp = names[s:e], fps[s:e]
                while len(own) > 1:
                    ones = _BYTE_BITS[fp.view(np.uint8).reshape(-1, 8)].sum(0).reshape(-1)
                    middle = np.packbits((2 * ones > len(fp)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
                    far = np.bitwise_count(fp ^ middle)
                    centre = int(np.lexsort((own, far))[0])
                    near = np.bitwise_count(fp ^ fp[centre]) <= FAR
                    a.append(np.full(int(near.sum()), own[centre]))
                    b.append(own[near])
                    own, fp = own[~near], fp[~near]
            a, b = np.concatenate([names[:0], *a]), np.concatenate([names[:0], *b])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            new = [batch.column("key").to_numpy(), batch.column("name").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            kept = [np.concatenate([x, y]) for x, y in zip(kept, new)]
            whole = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            if whole:
                yield settle(*(x[:whole] for x in kept))
                kept = [x[whole:] for x in kept]
        if len(kept[0]):
            yield settle(*kept)

    records = arrow_map(features.select("text_key", "sketches"), keyed, "key long, name long, fp long")
    n = partitions(features.sparkSession)
    return arrow_map(records.repartition(n, "key").sortWithinPartitions("key"), meet_pairs, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of five-word runs are as similar as asked for. Of every text in them, one row is read: the first.

    A set of bits, of one size for any number of pairs, keeps most other texts from being shuffled; the join is exact.
    """
    nodes = materialize(pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct().join(names, "text_key").select("text_key", F.coalesce("first", F.lit(_NO_ID)).alias("row")), "near-nodes")
    asked = texts.sparkSession.sparkContext.broadcast(bit_set(nodes.select(F.col("text_key").alias("key")), BITS_KEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in rows_in(batches):
            batch = batch.filter(pa.array(in_bits(asked.value, batch.column("text_key").to_numpy())))
            every = [own for _, own in word_runs(batch.column("text").to_pylist(), words)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("row"), pa.array(every, pa.list_(pa.int64()))], names=["text_key", "row", "runs"])

    chosen = texts.select("text_key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("row"), "text")
    sets = materialize(arrow_map(chosen, run, "text_key long, row long, runs array<long>").join(nodes, ["row", "text_key"]).select("text_key", "runs").dropDuplicates(["text_key"]), "near-runs")
    own = pairs.join(sets.select(F.col("text_key").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("text_key").alias("b"), F.col("runs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return materialize(own.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b"), "near-links")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, group, least): for every different text its group of near copies and the smallest doc_id in it.

    Texts are linked if their sets of five-word runs have a Jaccard similarity of ``similarity`` or more. A first pass takes
    candidates that share a Golay key of one of four sketches; a second one takes all pairs that its links leave apart and
    that share a run of their prefixes, so no link between groups is missed. Every candidate is verified on whole texts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text").cast("string").alias("text"))
    names = materialize(texts.groupBy("text_key").agg(F.min("doc_id").alias("first")), "near-names")
    features = materialize(_features(texts, similarity), "near-features")
    links = _verified(materialize(_candidates(features), "near-pairs"), texts, names, similarity)
    more = materialize(_prefix_pairs(features, components(links), similarity), "near-prefix-pairs")
    member = components(links.union(_verified(more, texts, names, similarity)))
    least = names.join(member, names.text_key == member.node).groupBy("component").agg(F.min("first").alias("least"))
    named = member.join(least, "component").select(F.col("node").alias("text_key"), F.col("component").alias("group"), "least")
    return names.join(named, "text_key", "left").select("text_key", F.coalesce("group", "text_key").alias("group"), F.coalesce("least", "first").alias("least"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns kept, without near copies of one with a smaller doc_id; of repeated rows one stays."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"))
    rows = given.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    stay = rows.join(near_copies(docs, similarity), "text_key").where(F.col("doc_id").eqNullSafe(F.col("least")))
    # texts of one group under one doc_id: one of them
    stay = materialize(stay.groupBy("group", F.col("least").alias("id")).agg(F.min(F.struct("text_key", "rows")).alias("s")).select("id", "s.text_key", "s.rows"), "near-stay")
    whole = docs.select(F.struct("*").alias("d"), key.alias("k"))
    kept = whole.join(stay, F.col("d.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("k") == F.col("text_key")))
    once = kept.where("rows = 1").select("d").union(kept.where("rows > 1").dropDuplicates(["id", "text_key"]).select("d"))
    return once.select(*(F.col("d")[c].alias(c) for c in docs.columns))
